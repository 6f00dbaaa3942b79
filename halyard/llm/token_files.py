"""Token-id files coded by an adaptive context-mixing range coder (operator 7).

Ids are coded in blocks of at most 4,096, each starting from a reset model and carrying its length, CRC-32 and size, so any block
can be read alone and a damaged one is noticed. Of each id the coder first says where it comes from: the id that last followed the
two ids before it (order 2), the id that last followed the one before it (order 1), the ids that the block has had (order 0), or
none of them. That choice is predicted by the added counts of two contexts: how sure the order-2 and order-1 guesses are, and the
previous id. An id of order 0 is then coded by its count in the block, a new one plainly. The coder is Java, run as a JVM function.

Tokenizing uses the tokenizers library. Where its pre-tokenizer is the byte-level one, a text falls apart at single spaces
without changing the ids, so each distinct piece is put to the library once per Python worker and looked up after that; texts with
any other white space than single spaces between words and line feeds, or with a special token, go to the library whole.

A file set is a folder of Parquet files, one row per run of whole documents: part and run number, document ids, starts and counts
of ids, and the coded blocks. Runs are in ascending key order: rows are range-partitioned and sorted by key, ties by a hash of the
text. Offsets come from sums per part and run, so nothing global is gathered in one task.

Null and empty texts hold the end id alone; null keys sort first; rows that repeat a key are documents of their own; a very long text
is a run of its own of as many blocks as it needs; an empty table makes an empty file set; other columns are not read, so their
names do not matter.
"""

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import read, scratch, small_batches
from halyard.llm.jvm import functions

#: Ids after which a run of documents ends.
RUN = 1 << 17
#: Bytes of text that are tokenized at a time; a longer text is taken alone.
SLICE = 4 << 20
#: Distinct pieces, and ids in all, that a worker keeps; beyond them it starts anew, which changes no result.
MAX_PIECES, MAX_IDS = 1_000_000, 12_000_000
#: White space, as the byte-level pre-tokenizer sees it, other than single spaces inside a text and line feeds.
_ODD_SPACE = r"  | \n| $|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The byte-level pre-tokenizer's published pattern, for texts of ASCII and Latin letters; others go through the library's own.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[ \\n!-~{_LATIN}]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\s0-9{_LATIN}]+|\\s+(?!\\S)|\\s+")


def register(spark: SparkSession) -> None:
    """SQL functions halyard_encode_tokens(ids, width) and halyard_decode_tokens(blocks, width), from binary to binary."""
    functions(spark, "token_blocks.java", {"halyard_encode_tokens": "halyard.EncodeTokens", "halyard_decode_tokens": "halyard.DecodeTokens"}, "binary")


class Tokens:
    """Ids of texts by the tokenizers library; what it made of a piece is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, special = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec["added_tokens"]]
        self.splits = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.odd = "|".join([_ODD_SPACE, *("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in special)])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # the byte-level alphabet
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}  # number of a piece or word that follows a space
        self.outer: dict[str, int] = {}  # number of any other one
        self.ids, self.ends = array("i"), array("q", [0])

    def _keep(self, ids: Iterable[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def _word(self, word: str) -> int:
        """Number of a pre-token."""
        kept, name = (self.inner, word[1:]) if word[0] == " " else (self.outer, word)
        n = kept.get(name)
        if n is None:
            if word.isascii():
                spelt = ("Ġ" + name if kept is self.inner else name).replace("\n", "Ċ")
            else:
                spelt = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
            n = kept[name] = self._keep([t.id for t in self.tok.model.tokenize(spelt)])
        return n

    def _piece(self, piece: str) -> int:
        """Number of a new piece: the ids of its pre-tokens."""
        if not _PLAIN.fullmatch(piece):
            return self._keep(self.tok.encode(piece, add_special_tokens=False).ids)
        words = _WORD.findall(piece)
        if len(words) == 1:
            return self._word(words[0])
        ids = array("i")
        for w in words:
            n = self._word(w)
            ids += self.ids[self.ends[n] : self.ends[n + 1]]
        return self._keep(ids)

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece, first piece of every text)."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        whole = np.flatnonzero(odd)
        some = [texts[int(i)].as_py() for i in whole]
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        at = split.offsets.to_numpy()[:-1].astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        used = np.zeros(len(pieces), bool)
        inside = np.ones(len(index), bool)
        inside[at] = False
        used[index[inside]] = True
        table, known = np.zeros(len(pieces), np.int64), self.inner
        for i in np.flatnonzero(used).tolist():
            w = pieces[i]
            n = known.get(w)
            if n is None:
                n = self._piece(" " + w)
                if "\n" not in w:  # line ends join words that seldom meet again
                    known[w] = n
            table[i] = n
        numbers = table[index]
        for i, j in zip(at.tolist(), index[at].tolist(), strict=True):
            w = pieces[j]
            n = self.outer.get(w)
            if n is None:
                n = self.outer[w] = self._piece(w) if w else self._keep([])
            numbers[i] = n
        for i, e in zip(whole.tolist(), self.tok.encode_batch_fast(some, add_special_tokens=False) if some else [], strict=True):
            numbers[at[i]] = self._keep(e.ids)
        return numbers, at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids of each text)."""
        if len(self.inner) + len(self.outer) > MAX_PIECES or len(self.ids) > MAX_IDS:
            self.clear()
        numbers, at = self._numbers(texts)
        ends = np.array(self.ends)
        start, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        counts = np.add.reduceat(size, at)
        total = int(counts.sum())
        out = np.full(total + len(at), end_id, np.int32)
        place = np.arange(total)
        source = place + np.repeat(start - (np.cumsum(size) - size), size)
        out[place + np.repeat(np.arange(len(at)), counts)] = np.frombuffer(self.ids, np.int32)[source] if total else 0
        return out, counts + 1


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per Python worker. The file is installed on every node; only its path travels."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE bytes."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SLICE, "right")))
        yield first, last
        first = last


_RUNS = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("width", pa.int32())])


def write_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Coded ids of every row's text and an end id, in ascending key order, as a file set under `folder`."""
    spark = df.sparkSession
    register(spark)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = tokens(tokenizer), 0
        width = max(1, max(tok.tok.get_vocab_size() - 1, end_id).bit_length())
        for b in batches:
            texts = pc.fill_null(b["text"], "")
            for first, last in _slices(texts):
                ids, counts = tok.encode(texts.slice(first, last - first), end_id)
                ends = np.cumsum(counts)
                cut = [0, *(np.flatnonzero(np.diff((ends - counts) // RUN)) + 1).tolist(), len(counts)]
                keys, rows = b["k"].slice(first, last - first), []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    base = int(ends[x] - counts[x])
                    rows.append((number, keys[x:y].to_pylist(), ends[x:y] - counts[x:y] - base, counts[x:y], ids[base : ends[y - 1]].tobytes()))
                    number += 1
                n = len(rows)
                columns = [pa.array([b["part"][0].as_py()] * n, pa.int32()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_RUNS)[1:6], strict=True)), pa.array([width] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("text")]
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, run int, keys array<long>, starts array<long>, counts array<long>, ids binary, width int")
    coded = runs.select("part", "run", "keys", "starts", "counts", F.expr("halyard_encode_tokens(ids, width)").alias("blocks"), "width")
    coded.write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_files(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 (and the ids, as bytes) of every document of a file set, decoded from its blocks."""
    register(spark)
    files = spark.read.parquet(folder)
    size = files.select("part", "run", F.expr("aggregate(counts, 0L, (s, x) -> s + x)").alias("n"))
    part = size.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.expr("sum(n) OVER (ORDER BY part) - n")).select("part", "base")  # one row per part file
    inside = size.withColumn("skip", F.expr("sum(n) OVER (PARTITION BY part ORDER BY run) - n")).drop("n")
    offsets = inside.join(part, "part").select("part", "run", (F.col("base") + F.col("skip")).alias("first"))
    own = "substring(b, CAST(4 * x.starts + 1 AS INT), CAST(4 * x.counts AS INT))"
    each = f"named_struct('k', x.keys, 'skip', x.starts, 'n', x.counts, 'crc', crc32({own}), 'ids', {own if with_ids else 'CAST(NULL AS BINARY)'})"
    # the outer transform binds the decoded run once
    docs = files.select("part", "run", F.expr(f"explode(flatten(transform(array(halyard_decode_tokens(blocks, width)), b -> transform(arrays_zip(keys, starts, counts), x -> {each})))) AS d"))
    out = docs.join(offsets, ["part", "run"]).select(F.col("d.k").alias(key), (F.col("first") + F.col("d.skip")).alias("start"), F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32"), F.col("d.ids").alias("ids"))
    return out if with_ids else out.drop("ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    write_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_files(spark, folder)
