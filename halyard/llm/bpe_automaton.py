"""BPE encoding and decoding by a tokenization automaton (operator 9).

The automaton reads tokens; its state is the last token read, and it accepts exactly the token sequences that the merges produce.
It starts with the base symbols, any of which may follow any other. Merge gadgets are applied in rank order: merging u and v into w
adds the state w with the row of arcs that v has at that time, lets w follow whatever u may follow, and takes the arcs to v, and to
what later merges make of v, away from u.

The compiled table has a row for each state: the sorted bounds of the runs of tokens that may not follow. Tokens are numbered in
preorder of the forest of left parts, later-made children first, so that each gadget takes one run of numbers away. A new state
shares its row with the one it was made from until either changes, so equal rows are stored once. A word is encoded from left to
right, with one transition a symbol of a second automaton that names the tokens ending there (Aho-Corasick over the spellings);
exactly one of them is the next state, the one whose number is in no run of the state before it. The path back from the end is the
encoding, and decoding emits the labels of its arcs through the file's own decoder (without one, separated by spaces).

Words come from the tokenizer file's own normaliser and pre-tokenizer, run once per distinct white-space-separated piece; special
tokens in a text are cut out first, as the tokenizers library does. A worker's table of known pieces is bounded and starts anew when
full, which changes no result. Texts are encoded whole, however long, and row by row, without a shuffle, so repeated rows, ties and
null ids are harmless; other columns are not read, so their names do not matter. Null and empty texts have no ids and decode to
the empty string. An empty table gives no rows.
"""

import hashlib
import json
import re
import struct
from array import array
from bisect import bisect_left, bisect_right

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import read

MAX_PIECES = 1_000_000
#: Characters that the normaliser only lower-cases one by one, and none of which is white space.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


#: Stands for the end-of-word suffix in spellings; no byte-level symbol is this character.
_END = "\uffff"


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.label = {i: t for t, i in vocab.items()}
        made = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        born = {w: r for r, (_, _, w) in enumerate(made)}
        if len(born) < len(made):
            raise ValueError("two merges make the same token")
        self.place, self.rows = self._compile(made, born)
        single = {t for t in vocab if len(t) == 1 or (suffix and len(t) == 1 + len(suffix) and t.endswith(suffix))}
        self.reader = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.rows and (i in born or t in single):  # no merge makes any other
                spelt = t.removesuffix(suffix) + _END if suffix and t.endswith(suffix) else t
                self.reader.add_word(spelt, (i, len(spelt), self.place[i]))
        self.reader.make_automaton()
        self.symbols = {t.removesuffix(suffix) if suffix else t for t in single}

    def _compile(self, made: list[tuple[int, int, int]], born: dict[int, int]) -> tuple[dict[int, int], dict[int, array]]:
        """(number of every token, row of every state) after all gadgets."""
        grown: dict[int, list[int]] = {}  # what merges make with a token as the left part, and their ranks, ascending
        ranks: dict[int, list[int]] = {}
        for r, (u, _, w) in enumerate(made):
            grown.setdefault(u, []).append(w)
            ranks.setdefault(u, []).append(r)
        place: dict[int, int] = {}
        end: dict[int, int] = {}
        todo = [(i, True) for i in sorted(self.label, reverse=True) if i not in born]
        while todo:
            i, enter = todo.pop()
            if enter:
                place[i] = len(place)
                todo.append((i, False))
                todo += [(w, True) for w in grown.get(i, ())]  # the last made is taken first
            else:
                end[i] = len(place)
        lists: dict[int, tuple | None] = dict.fromkeys(self.label)  # (first, bound, the list it extends)
        lost = set()
        for r, (u, v, w) in enumerate(made):
            at = lists[u]
            while at and not at[0] <= place[v] < at[1]:
                at = at[2]
            if at or u in lost or v in lost:  # an earlier merge always comes first: this one never applies
                lost.add(w)
                continue
            lists[w] = lists[v]
            later = bisect_left(ranks.get(v, []), r)  # of u = v: w itself too, as merges go from left to right
            bound = end[grown[v][later]] if later < len(ranks.get(v, [])) else place[v] + 1
            lists[u] = (place[v], bound, lists[u])
        shared: dict[int, array] = {}
        rows = {}
        for i, cell in lists.items():
            row = shared.get(id(cell))
            if row is None:
                runs, at = [], cell
                while at:
                    runs.append(at[:2])
                    at = at[2]
                row = shared[id(cell)] = array("i")
                for a, b in sorted(runs):
                    if row and a <= row[-1]:
                        row[-1] = max(row[-1], b)
                    else:
                        row.extend((a, b))
            rows[i] = row
        return place, {i: row for i, row in rows.items() if i not in lost}

    def follows(self, x: int, y: int) -> bool:
        """Whether there is an arc from state x by token y."""
        return not bisect_right(self.rows[x], self.place[y]) & 1

    def encode(self, word: str) -> list[int]:
        if not self.symbols.issuperset(word):
            word = "".join(c for c in word if c in self.symbols)  # symbols outside the vocabulary are left out
        text = word + _END if self.suffix else word
        state: list[int | None] = [None] * (len(text) + 1)
        rows, size_of = self.rows, [0] * (len(text) + 1)
        for end, (t, size, number) in self.reader.iter(text):
            end += 1
            if state[end] is None:
                start = end - size
                if start:
                    last = state[start]
                    if last is None or bisect_right(rows[last], number) & 1:
                        continue
                state[end], size_of[end] = t, size
        out, at = [], len(text) if word else 0
        while at:
            out.append(state[at])
            at -= size_of[at]
        return out[::-1]


class Encoder:
    def __init__(self, data: str):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        tok = Tokenizer.from_str(data)
        self.normalizer, self.pre, self.decoder = tok.normalizer, tok.pre_tokenizer, tok.decoder
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.auto = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.auto.label | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[bytes, tuple[bytes, str]] = {}
        # the pre-tokenizer's pattern, read from the file, serves plain pieces directly; all others go through the library
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if split and norms == ["NFC", "Replace", "Lowercase"] else None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # the byte-level alphabet

    def words(self, part: str) -> list[str]:
        if self.pattern and _PLAIN.fullmatch(part):
            return [w.encode().decode("latin-1").translate(self.bytes) for w in self.pattern.findall(part.lower())]
        text = self.normalizer.normalize_str(part) if self.normalizer else part
        return [w for w, _ in self.pre.pre_tokenize_str(text)]

    def piece(self, s: str) -> tuple[bytes, str]:
        ids: list[int] = []
        for part in self.cut.split(s) if self.cut else [s]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for w in self.words(part):
                    ids += self.auto.encode(w)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(self.label[i] for i in ids)

    def document(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text)."""
        ids, words, known = [], [], self.known
        for s in (text or "").encode("utf-8", "surrogatepass").split():  # bytes split at ASCII white space only
            got = known.get(s)
            if got is None:
                if len(known) >= MAX_PIECES:
                    known.clear()
                got = known[s] = self.piece(s.decode("utf-8", "surrogatepass"))
            if got[0]:
                ids.append(got[0])
                words.append(got[1])
        coded = b"".join(ids)
        if self.decoder:
            return coded, self.decoder.decode([self.label[i] for (i,) in struct.iter_unpack("<I", coded)])
        return coded, " ".join(words)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker. The file is installed on every node; only its path travels."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            _ENCODERS[path] = Encoder(f.read())
    return _ENCODERS[path]


def digests(path: str, text: str = "text") -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        e, rows = encoder(path), []
        for t in texts:
            ids, decoded = e.document(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text))


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded text per row."""

    def run(texts: pd.Series) -> pd.DataFrame:
        import numpy as np

        got = [encoder(path).document(t) for t in texts]
        return pd.DataFrame({"ids": [np.frombuffer(i, "<u4").astype("int32") for i, _ in got], "decoded": [d for _, d in got]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    out = df.select(F.col(key).alias(key), F.pandas_udf(run, "ids array<int>, decoded string")(F.col(text)).alias("e"))
    return out.select(key, "e.ids", "e.decoded")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = read(spark, sf_dir, "documents").select("doc_id", digests(public_tokenizers.path("word_bpe_49k.json")).alias("d"))
    return out.select("doc_id", "d.*")
