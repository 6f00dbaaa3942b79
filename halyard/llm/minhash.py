"""Near-duplicate groups by MinHash with tensored banding (operator 1).

Two collections A and B hold m band hashes each, of ROWS minhashes. Table (i, j) is keyed by the pair (A_i, B_j), so m * m tables
of 2 * ROWS minhashes come from 2 * m * ROWS minhashes. m follows from the threshold: a pair exactly at it is missed with
probability below MISS, and much less often above it.

1. Signatures: one Arrow pass; documents with equal shingle sets become one class (map-side combined), represented by its
   smallest id. Only representatives go on.
2. Buckets: a representative enters table (i, j) only if some other one shares A_i and some other one shares B_j.
3. Links: in each bucket the member that is best connected over all tables is the hub, and every other member is compared with
   it on full sets. Two members that both link to their hub need no test of their own. For the others an exact prefix filter works
   on each member's difference from the hub: shingles added, and shingles removed, with |x ^ y| = |Dx ^ Dy|. As x does not link to the
   hub, Dx is large, so a linked pair must share elements at the head of both differences; where both have added much, already at
   the head of what they added, which keeps pages of one template apart. Heads are taken by rarity among the hub's members: what no
   other member has comes first and can meet nothing. Only pairs that meet in their heads are compared on full sets. Groups of
   copies are thus linked by stars, never by all pairs, and no pair that meets in a table is dropped.
4. Components: minimum labels spread over links with pointer jumping; each round is a written table.

Every exchange is by bucket key, document or link; hot keys are only in joins, which Spark splits, and in aggregates that
combine before the shuffle. Sets hold 64-bit hashes of shingles, of whole texts however long; "full sets" are these, so two
different shingles count as one with a chance of 2^-64 a pair.

A document without words (null, empty or white space) links to nothing and is its own component. A null id gets no component and is
not kept; rows that repeat an id and text fall in one component, each row being returned. Of ties the smallest id represents a
class and a component. Other columns are not read, so their names do not matter. An empty table gives no rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import shingles as S
from halyard.llm.common import drop_written, read, small_batches, tidied, written

ROWS = 3
MISS = 5e-4


def collections(threshold: float) -> int:
    """Band hashes in each collection: both must hit, each missing with probability (1 - t^ROWS)^m."""
    return max(1, math.ceil(math.log(MISS / 2) / math.log(1 - threshold**ROWS)))


def signatures(df: DataFrame, key: str, text: str, words: int, m: int) -> DataFrame:
    """id, n, d1, d2 (digest of the set) and bands: m hashes of A, then m of B; null for an empty set."""
    rng = np.random.Generator(np.random.PCG64(97))
    mul, add = rng.integers(1, 2**63, 2 * m * ROWS, dtype=S.U) * S.U(2) + S.U(1), rng.integers(1, 2**63, 2 * m * ROWS, dtype=S.U)
    tag = S.mix(np.arange(1, 2 * m + 1, dtype=S.U))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            ids = b["id"]
            for first, docs in S.chunks(b["text"].tolist()):
                sets, n = S.shingle_sets(docs, words)
                some = np.flatnonzero(n)
                d1, d2 = np.zeros(len(docs), S.U), np.zeros(len(docs), S.U)
                bands: list = [None] * len(docs)
                if len(some):
                    at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    d1[some], d2[some] = np.add.reduceat(sets, at), np.bitwise_xor.reduceat(S.mix(sets ^ S.U(0x5851F42D4C957F2D)), at)
                    sig = np.empty((2 * m * ROWS, len(some)), S.U)
                    for i in range(len(sig)):
                        sig[i] = np.minimum.reduceat((sets ^ add[i]) * mul[i], at)
                    h = np.zeros((2 * m, len(some)), S.U)
                    for r in range(ROWS):
                        h = S.mix((h + sig[r :: ROWS]) * S.U(0x9E3779B97F4A7C15) + tag[:, None])
                    h = h.view(np.int64).T
                    for i, row in zip(some, h, strict=True):
                        bands[i] = row
                yield pd.DataFrame({"id": ids.iloc[first : first + len(docs)].to_numpy(), "n": n, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "bands": bands}).astype({"id": "Int64"})

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, n long, d1 long, d2 long, bands array<long>")


def buckets(reps: DataFrame, m: int) -> DataFrame:
    """(key, id, n) of the tables' entries whose two halves are both shared with another representative."""
    half = reps.select("id", "n", F.posexplode("bands").alias("i", "h"))
    shared = half.groupBy("i", "h").agg(F.count("*").alias("c")).filter("c > 1").select("i", "h")
    hit = half.join(shared, ["i", "h"]).groupBy("id", "n").agg(F.collect_list(F.struct("i", "h")).alias("hs"))  # at most 2 m
    a = hit.select("id", "n", F.explode(F.expr(f"filter(hs, x -> x.i < {m})")).alias("a"), F.expr(f"filter(hs, x -> x.i >= {m})").alias("bs"))
    pair = a.select("id", "n", "a", F.explode("bs").alias("b"))
    return pair.select(F.xxhash64("a.i", "a.h", "b.i", "b.h").alias("key"), "id", "n")


def sets_of(df: DataFrame, ids: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, s): sorted shingle hashes, as bytes, of the given ids' texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            keys = b["id"].tolist()
            for first, docs in S.chunks(b["text"].tolist()):
                sets, n = S.shingle_sets(docs, words)
                parts = np.split(sets, np.cumsum(n)[:-1])
                yield pd.DataFrame({"id": keys[first : first + len(docs)], "s": [p.tobytes() for p in parts]})

    some = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return some.mapInPandas(run, "id long, s binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (u, v) pairs with den * |intersection| >= num * |union|."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            keep = []
            for x, y in zip(b["su"], b["sv"], strict=True):
                p, q = np.frombuffer(x, S.U), np.frombuffer(y, S.U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield b.loc[keep, ["u", "v"]]

    x = pairs.join(sets.withColumnsRenamed({"id": "v", "s": "sv"}), "v").join(sets.withColumnsRenamed({"id": "u", "s": "su"}), "u")
    return x.select("u", "v", "su", "sv").mapInPandas(run, "u long, v long")


def stars(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, x, nx, na, d, linked, diff) of hub and member pairs: diff holds the na shingles that x has and h has not, then the others
    of the d in which they differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidied(batches):
            rows = []
            for h, x, sh, sx in zip(b["h"], b["x"], b["sh"], b["sx"], strict=True):
                p, q = np.frombuffer(sh, np.int64), np.frombuffer(sx, np.int64)
                added, removed = np.setdiff1d(q, p, assume_unique=True), np.setdiff1d(p, q, assume_unique=True)
                both = len(q) - len(added)
                linked = den * both >= num * (len(p) + len(q) - both)
                rows.append((h, x, len(q), len(added), len(added) + len(removed), linked, np.concatenate([added, removed])))
            yield pd.DataFrame(rows, columns=["h", "x", "nx", "na", "d", "linked", "diff"])

    j = pairs.join(sets.withColumnsRenamed({"id": "x", "s": "sx"}), "x").join(sets.withColumnsRenamed({"id": "h", "s": "sh"}), "h")
    return j.select("h", "x", "sh", "sx").mapInPandas(run, "h long, x long, nx long, na long, d long, linked boolean, diff array<long>")


def heads(star: DataFrame, num: int, den: int) -> DataFrame:
    """(h, e, x, nx, na, d, more, pa, pd, by_added, by_all, by_linked, by_probe): the elements of differences in which a pair must meet.

    more: how far what x added exceeds its share of a link's allowance, times den + num; pa and pd: places, by rarity, in what x
    added and in its whole difference. by_added: a head for partners with `more` above 0 as well; by_all: for other
    partners that do not link to the hub; by_probe: for those that do, whose own heads are by_linked.
    """
    both, less = den + num, den - num
    hubs = star.groupBy("h").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("far")).filter("n > 1 AND far > 0")
    el = star.join(hubs.select("h"), "h").select("h", "x", "nx", "na", "d", "linked", F.posexplode("diff").alias("i", "e"))
    el = el.select("h", "x", "nx", "na", "d", "linked", "e", F.expr("i < na").alias("a"))
    seen = el.groupBy("h", "e").agg(F.count("*").alias("c"), F.count_if(~F.col("linked")).alias("far")).filter("c > 1 AND far > 0").select("h", "e", "c")
    shared = el.join(seen, ["h", "e"])  # all others can meet nothing, and come first
    place = "{n} - count(*) OVER (PARTITION BY {w}) + row_number() OVER (PARTITION BY {w} ORDER BY c, e) - 1"
    shared = shared.withColumn("pd", F.expr(place.format(n="d", w="h, x"))).withColumn("pa", F.expr(place.format(n="na", w="h, x, a")))
    shared = shared.withColumn("more", F.expr(f"{both} * na - {less} * nx"))
    first = f"d - ({both} * d + {less} * (d - 2 * na)) div {2 * both}"  # d - 2 * na: how much larger the hub is
    shared = shared.withColumns({
        "by_added": F.expr(f"NOT linked AND a AND more > 0 AND pa < na - more div {2 * both}"),
        "by_all": F.expr(f"NOT linked AND pd < {first}"),
        "by_linked": F.expr(f"linked AND pd < {first}"),
        "by_probe": F.expr(f"NOT linked AND pd <= d - greatest(1, CAST(ceil(({num} * d - {less} * nx) / {num}) AS BIGINT))"),
    })
    return shared.drop("c", "a", "linked").filter("by_added OR by_all OR by_linked OR by_probe")


def across(star: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): pairs of one hub's members that may link although not both link to the hub."""
    both, less = den + num, den - num
    head = written(heads(star, num, den), "heads")

    def side(which: str, s: str) -> DataFrame:
        return head.filter(which).select("h", "e", *[F.col(c).alias(f"{c}_{s}") for c in ("x", "nx", "na", "d", "more", "pa", "pd")])

    def meet(left: str, right: str, fits: str) -> DataFrame:
        pairs = side(left, "u").join(side(right, "v"), ["h", "e"]).filter(f"x_u <> x_v AND {den} * least(nx_u, nx_v) >= {num} * greatest(nx_u, nx_v) AND {fits}")
        return pairs.select(F.least("x_u", "x_v").alias("u"), F.greatest("x_u", "x_v").alias("v"))

    # at the first element that two differences share, what follows it must still make up the overlap that a link needs
    added = f"x_u < x_v AND {2 * both} * least(na_u - pa_u, na_v - pa_v) >= more_u + more_v"
    whole = f"{2 * both} * least(d_u - pd_u, d_v - pd_v) >= {both} * (d_u + d_v) - {less} * (nx_u + nx_v)"
    out = meet("by_added", "by_added", added).union(meet("by_all AND more <= 0", "by_all", whole)).union(meet("by_probe", "by_linked", whole))
    return out.distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, c): the smallest id that each node reaches. nodes: id."""
    both = written(links.select("u", "v").union(links.select("v", "u")).distinct(), "links")
    label = written(nodes.select("id", F.col("id").alias("c")), "labels")
    while True:
        best = both.join(label.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("c").alias("m")).withColumnRenamed("u", "id")
        step = label.join(best, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("p"), F.col("c").alias("old"))
        jump = step.join(label.select(F.col("id").alias("p"), F.col("c").alias("cp")), "p", "left")
        new = written(jump.select("id", F.least("p", F.coalesce("cp", "p")).alias("c"), "old"), "labels")
        moved = new.filter("c <> old").limit(1).count()
        drop_written(label)
        label = new.select("id", "c")
        label._halyard_path = new._halyard_path
        if not moved:
            drop_written(both)
            return label


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """key, n_shingles, component_id, kept per row. Links: den * intersection >= num * union of the word-shingle sets."""
    small_batches(df.sparkSession)
    m = collections(num / den)
    sig = written(signatures(df, key, text, words, m), "signatures")
    classes = sig.filter("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    reps = written(classes, "classes")
    member = written(buckets(reps, m), "buckets")
    size = member.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    scored = member.join(size, "key")
    score = scored.groupBy("id").agg(F.sum("c").alias("score"))
    ranked = written(scored.drop("c").join(score, "id"), "ranked")
    drop_written(member)
    sets = written(sets_of(df, ranked.select("id").distinct(), key, text, words).dropDuplicates(["id"]), "sets")

    hub = ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("hub"))
    met = ranked.join(hub.select("key", (-F.col("hub.neg")).alias("h")), "key").filter("id <> h").select("h", F.col("id").alias("x")).distinct()
    star = written(stars(met, sets, num, den), "stars")
    more = verified(across(star, num, den), sets, num, den)
    links = written(star.filter("linked").select(F.col("h").alias("u"), F.col("x").alias("v")).union(more), "verified")
    comp = components(links, ranked.select("id").distinct())
    labelled = reps.join(comp, "id", "left").select("n", "d1", "d2", F.coalesce("c", "id").alias("component_id"))
    empty = sig.filter("n = 0 OR id IS NULL").select("id", "n", F.when(F.col("n") == 0, F.col("id")).alias("component_id"))
    full = sig.filter("n > 0 AND id IS NOT NULL").join(labelled, ["n", "d1", "d2"]).select("id", "n", "component_id")
    out = full.unionByName(empty)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), num=85)
