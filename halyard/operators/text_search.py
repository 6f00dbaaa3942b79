"""Ranked text search: postings, BM25, TF-IDF cosine and MATCH scores.

A query's words are few and bounded, so only their document frequencies are collected; everything per document stays distributed.
"""

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as T
from halyard.sources.shared import shared_dir

MAX_TOKEN_BYTES = 128


def analyse(df: DataFrame, text: str, key: str, stopwords: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """(doc, token) rows of the Spanish analyser: stop words dropped, then one stem per distinct word by a join."""
    stop = T.stopwords() if stopwords is None else stopwords
    words = df.select(F.col(key).alias("doc"), F.explode(F.expr(T.clean_words(f"`{text}`"))).alias("word"))
    words = words.filter(~F.col("word").isin(stop)) if stop else words
    words = words.filter(F.octet_length("word") <= max_bytes) if max_bytes else words

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "token": [T.analyse_word(w) for w in b["word"]]})

    stem = words.select("word").distinct().mapInPandas(stems, "word string, token string")
    return words.join(stem, "word").select("doc", "token").filter("token <> ''")


def tokens(df: DataFrame, text: str, key: str, tokenizer=T.match_tokens) -> DataFrame:
    """(doc, token) rows of an expression tokenizer."""
    return df.select(F.col(key).alias("doc"), F.explode(F.expr(tokenizer(f"`{text}`"))).alias("token"))


class InvertedIndex:
    """Postings (term, doc, tf), term statistics and document statistics as DataFrames. Every document counts in N, also empty ones."""

    def __init__(self, docs: DataFrame, token_rows: DataFrame):
        """docs: one column `doc` with every key."""
        self.postings = token_rows.groupBy(F.col("token").alias("term"), "doc").agg(F.count("*").alias("tf"))
        self.docs = docs.select("doc")

    @staticmethod
    def stored(spark: SparkSession, path: str, docs: DataFrame, token_rows: DataFrame | None) -> "InvertedIndex":
        """The index kept under `path`, built there first if it is not: one pass over the texts; postings dealt by term and document, so
        that no word is hot, and sorted by term in each file, so that a query reads the row groups of its words; documents with length and norm; terms with document frequency."""
        ix = InvertedIndex.__new__(InvertedIndex)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop(path)):  # made under another name first, so that a half-made one is never read
            draft = f"{path}-{uuid.uuid4().hex}"
            made = InvertedIndex(docs, token_rows)
            made.postings.sortWithinPartitions("term", "doc").write.parquet(f"{draft}/postings")
            made.postings = spark.read.parquet(f"{draft}/postings")
            made.terms().write.parquet(f"{draft}/terms")
            made._terms = spark.read.parquet(f"{draft}/terms")
            each = made.lengths().join(made.norms(), "doc")
            made.docs.join(each, "doc", "left").fillna(0, ["dl"]).write.parquet(f"{draft}/docs")
            fs.mkdirs(hadoop(path).getParent())
            if fs.exists(hadoop(path)) or not fs.rename(hadoop(draft), hadoop(path)):  # another was first
                fs.delete(hadoop(draft), True)
        ix.postings, ix._terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
        ix._docs = spark.read.parquet(f"{path}/docs")
        ix.docs = ix._docs.select("doc")
        return ix

    _terms: DataFrame | None = None
    _docs: DataFrame | None = None

    def terms(self) -> DataFrame:
        if self._terms is not None:
            return self._terms
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def lengths(self) -> DataFrame:
        if self._docs is not None:
            return self._docs.filter("dl > 0").select("doc", "dl")
        return self.postings.groupBy("doc").agg(F.sum("tf").alias("dl"))

    def totals(self) -> tuple[int, float]:
        if self._docs is not None:
            r = self._docs.agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
            return r.n, (r.dl or 0) / r.n if r.n else 0.0
        n, length = self.docs.count(), self.postings.agg(F.sum("tf")).first()[0] or 0
        return n, length / n if n else 0.0

    def statistics(self) -> DataFrame:
        d = self.docs.agg(F.count("*").alias("documents"))
        return d.crossJoin(self.postings.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))).withColumn("avgdl", F.expr("tokens / documents"))  # two single rows

    def _query(self, words: list[str]) -> tuple[DataFrame, dict[str, int]]:
        asked = F.col("term").isin(sorted(set(words)))
        hits = self.postings.filter(asked)
        df = self._terms.filter(asked) if self._terms is not None else hits.groupBy("term").agg(F.count("*").alias("df"))
        return hits, {r.term: r.df for r in df.collect()}

    def bm25(self, words: list[str], k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc, score) of the k best documents for the distinct words, ties to the smaller key."""
        n, avgdl = self.totals()
        hits, df = self._query(words)
        hits = hits.join(_frame(hits, df, "df"), "term").join(self.lengths(), "doc")
        idf = F.expr(f"ln(1 + ({n} - df + 0.5D) / (df + 0.5D))")
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0)))
        return _top(hits.groupBy("doc").agg(F.sum(part).alias("score")), k)

    def norms(self) -> DataFrame:
        if self._docs is not None:
            return self._docs.select("doc", "norm")
        n = self.docs.count()
        w = self.postings.join(self.terms(), "term").withColumn("w", F.expr(f"(1 + ln(tf)) * ln({n}D / df)"))
        return w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def cosine(self, words: list[str], k: int | None = 10) -> DataFrame:
        """(doc, score): cosine of (1 + ln tf) * ln(N / df) weights, in [0, 1]; only positive scores."""
        n = self.docs.count()
        hits, df = self._query(words)
        import math

        q = {t: (1 + math.log(c)) * math.log(n / df[t]) for t, c in Counter(words).items() if t in df}
        qn = math.sqrt(sum(v * v for v in q.values()))
        if not qn:
            return self.docs.select("doc", F.lit(0.0).alias("score")).filter("false")
        w = hits.join(_frame(hits, df, "df"), "term").join(_frame(hits, q, "qw"), "term")
        dot = w.groupBy("doc").agg(F.sum(F.expr(f"(1 + ln(tf)) * ln({n}D / df) * qw")).alias("dot"))
        score = F.expr(f"least(1D, greatest(0D, dot / (norm * {qn!r}D)))")
        return _top(dot.join(self.norms(), "doc").filter("norm > 0").select("doc", score.alias("score")), k)


def _frame(like: DataFrame, values: dict, name: str) -> DataFrame:
    """A query's few words and a number each; bounded by the query's length."""
    return like.sparkSession.createDataFrame([(t, float(v)) for t, v in values.items()], f"term string, {name} double")


def _top(scored: DataFrame, k: int | None) -> DataFrame:
    out = scored.filter("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), "doc").limit(k)


def index(df: DataFrame, text: str, key: str, analyser: str = "spanish", path: str | None = None, **options) -> InvertedIndex:
    """An index of the rows' texts, stored under `path` if that is given; a stored one is taken as it is."""
    rows = analyse(df, text, key, **options) if analyser == "spanish" else tokens(df, text, key, T.ranker_tokens if analyser == "words" else T.match_tokens)
    docs = df.select(F.col(key).alias("doc"))
    return InvertedIndex.stored(df.sparkSession, path, docs, rows) if path else InvertedIndex(docs, rows)


def file_index(df: DataFrame, text: str, key: str, analyser: str = "spanish", **options) -> InvertedIndex:
    """The index of a table read from files, stored in the shared folder under a name made of those files, their sizes and times, so
    that it is built once a version of the files and never read for another."""
    spark = df.sparkSession
    hadoop, names = spark._jvm.org.apache.hadoop.fs.Path, set(df.inputFiles())
    files = []
    for parent in sorted({n.rsplit("/", 1)[0] for n in names}):  # one listing a folder
        folder = hadoop(spark._jvm.java.net.URI(parent))
        for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
            if f"{parent}/{s.getPath().toUri().getRawPath().rsplit('/', 1)[1]}" in names:
                files.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    if not files or len(files) != len(names):  # not files that can be told apart
        return index(df, text, key, analyser, **options)
    files.sort()
    name = hashlib.sha256(repr((files, text, key, analyser, sorted(options.items()))).encode()).hexdigest()[:32]
    return index(df, text, key, analyser, f"{shared_dir(spark)}/halyard-text-{name}", **options)


def analyse_query(query: str, stopwords: list[str] | None = None) -> list[str]:
    """The Spanish analyser on one short string, on the driver."""
    stop = set(T.stopwords() if stopwords is None else stopwords)
    words = "".join(" " if c in T.PUNCTUATION else c for c in query.lower()).split()
    return [s for s in (T.analyse_word(w) for w in words if w not in stop) if s]


def match_score(df: DataFrame, text: str, query: str, mode: str = "tf-idf") -> str:
    """SQL text of the MATCH score of `text`: sum over distinct query words of (n / len) * idf, idf = ln((N+1)/(df+1)) + 1, or 1 for 'tf'.

    One aggregate job finds N and each word's document frequency.
    """
    import re

    words = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))
    if not words:
        return "0D"
    toks = T.match_tokens(text)
    if mode == "tf":
        idf = [1.0] * len(words)
    else:
        import math

        hits = [F.expr(f"count_if(array_contains({toks}, {_quote(w)}))").alias(f"d{i}") for i, w in enumerate(words)]
        r = df.agg(F.count(F.lit(1)).alias("n"), *hits).first()
        idf = [math.log((r["n"] + 1) / (r[f"d{i}"] + 1)) + 1 for i in range(len(words))]
    total = " + ".join(f"size(filter(ts, t -> t = {_quote(w)})) * {x!r}D" for w, x in zip(words, idf, strict=True))
    return f"coalesce(element_at(transform(array({toks}), ts -> CASE WHEN size(ts) > 0 THEN ({total}) / size(ts) ELSE 0D END), 1), 0D)"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def search_methods(df: DataFrame, text: str, key: str, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75, stopwords: list[str] | None = None) -> DataFrame:
    """Both methods side by side: method, rank, doc, score and the query words that the document holds. k is held to 1..200."""
    from pyspark.sql import Window

    k = min(200, max(1, k))
    words = analyse_query(query, stopwords)
    ix = (file_index if df.inputFiles() else index)(df, text, key, stopwords=stopwords, max_bytes=MAX_TOKEN_BYTES)
    both = ix.bm25(words, k, k1, b).withColumn("method", F.lit("bm25")).unionByName(ix.cosine(words, k).withColumn("method", F.lit("tf-idf")))
    seen = ix.postings.filter(F.col("term").isin(sorted(set(words)))).groupBy("doc").agg(F.sort_array(F.collect_set("term")).alias("matched"))  # at most the query's words
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "doc"))
    return both.join(seen, "doc").withColumn("rank", rank).select("method", "rank", "doc", "score", "matched")


def bm25_batch(ix: InvertedIndex, queries: DataFrame, k: int = 10, tokenizer=T.match_tokens, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Many queries in one job: (query_id, rank, doc, score). queries: query_id, text.

    Only postings of query words are read on; a word that many queries hold, or many documents, is a join key that Spark splits.
    The best k of each query are picked in each partition before they meet.
    """
    from pyspark.sql import Window

    q = tokens(queries, "text", "query_id", tokenizer).distinct().withColumnsRenamed({"doc": "query_id", "token": "term"})
    n, avgdl = ix.totals()
    asked = q.select("term").distinct().join(ix.terms(), "term")
    part = F.expr(f"ln(1 + ({n} - df + 0.5D) / (df + 0.5D)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / {avgdl or 1.0!r}D))")
    weighted = ix.postings.join(asked, "term").join(ix.lengths(), "doc").select("term", "doc", part.alias("s"))
    scored = weighted.join(q, "term").groupBy("query_id", "doc").agg(F.sum("s").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def relevance(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Precision@k and recall@k per query of (query_id, rank, doc) against (query_id, doc); queries without judgments are left out."""
    known = qrels.select("query_id", "doc").distinct()
    hits = results.filter(F.col("rank") <= k).select("query_id", "doc").join(known, ["query_id", "doc"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    base = known.groupBy("query_id").agg(F.count("*").alias("relevant")).join(hits, "query_id", "left").fillna(0, ["hits"])
    return base.select("query_id", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"))


def latency_summary(df: DataFrame) -> DataFrame:
    """Median and nearest-rank p95 of `ms` per bucket of `words`: 1, 3 (2 to 4) and 5 or more."""
    bucket = F.expr("CASE WHEN words <= 1 THEN '1' WHEN words < 5 THEN '3' ELSE '5+' END")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.expr("percentile(ms, 0.5)").alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"))


def sample_corpus(df: DataFrame, key: str, anchors: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """A reproducible sample of about n rows by hash order that always holds the anchored keys."""
    a = anchors.select(key).distinct()
    rest = df.join(a, key, "left_anti").orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return df.join(a, key, "left_semi").unionByName(rest)


def export_index(ix: InvertedIndex, path: str) -> None:
    """Postings and document statistics as JSON lines under one folder."""
    ix.postings.write.mode("overwrite").json(f"{path}/postings")
    ix.docs.join(ix.lengths(), "doc", "left").fillna(0, ["dl"]).write.mode("overwrite").json(f"{path}/documents")


def import_index(spark: SparkSession, path: str) -> InvertedIndex:
    p = spark.read.schema("term string, doc long, tf long").json(f"{path}/postings")
    d = spark.read.schema("doc long, dl long").json(f"{path}/documents")
    ix = InvertedIndex(d, p.select("doc", F.col("term").alias("token")))
    ix.postings = p
    return ix
