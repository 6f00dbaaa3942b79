"""Exact top-k inner products by multi-resolution segment statistics (operator 4).

For a query q and a candidate x cut into segments, the segment means m and deviations d bound the squared distance from below by the
sum of n * ((mq - mx)^2 + (dq - dx)^2), which is the same as bounding the inner product from above by the sum of
n * (mq * mx + dq * dx): one small matrix product per resolution. In each pair of blocks of ROWS queries and ROWS candidates the
coarse bounds pick k candidates per query, whose exact scores give a threshold, and a task carries the best scores of a query on to its
next candidate block; what passes the coarse and then the fine bounds is scored exactly, by a matrix product where it fills one.

Candidates are dealt into groups of about GROUP_BYTES, queries likewise, and each pair of groups is one cogroup of bounded size, so neither
side is broadcast or collected and the number of groups follows the data. A cogroup gives k rows per query at most; a window keeps
the best k of all.

Scores are integers: exact in float64 up to 2^53, beyond that Python integers, held to the range of a long. Vectors that are null,
empty, or hold a null or non-finite component take no part, nor do rows without id; vectors of different dimension never meet.
Repeated ids are separate rows: each is a query, and only the row itself is left out of its candidates. Ties go to the smaller id. Long
vectors make smaller groups. Other columns are not read, so their names do not matter. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import read, written

ROWS = 2048
#: Bytes of vectors, as doubles, in a group of candidates or queries.
GROUP_BYTES = 16 << 20
#: A small table's queries are dealt into so many groups at most; each meets a copy of the candidates.
QUERY_GROUPS = 4
LEVELS = (4, 16)
SCALE = 64
#: Pairs are scored by a matrix product if they are at least one in so many of its cells.
DENSE = 16
_I64 = np.iinfo(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(n, 2 s): sqrt(size) * mean and sqrt(size) * deviation of each segment."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    mean = np.stack([x[:, p].mean(1) for p in parts], 1)
    dev = np.stack([x[:, p].std(1) for p in parts], 1)
    return np.concatenate([mean, dev], 1) * np.sqrt(np.tile([len(p) for p in parts], 2))


def products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xj: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (qi, xj) of rows."""
    chunks = range(0, len(qi), 1 << 18)
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[qi[at : at + (1 << 18)]], x[xj[at : at + (1 << 18)]]) for at in chunks)])


def fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether float64 adds these integers exactly: no sum can pass 2^53."""
    return q.shape[1] * np.abs(q).max() * np.abs(x).max() < 2**53


def scores(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xj: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (qi, xj) of rows."""
    if fits(q, x):
        return products(q, x, qi, xj).astype(np.int64)
    out = (sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(qi, xj, strict=True))
    return np.array([min(max(v, int(_I64.min)), int(_I64.max)) for v in out], np.int64)


def best_of(k: int, *found: np.ndarray) -> np.ndarray:
    """(n, k): the k largest of each row, filled up with -inf."""
    s = np.concatenate([*found, np.full((len(found[0]), k), -np.inf)], axis=1)
    return -np.partition(-s, k - 1, axis=1)[:, :k]


def block_top(q: np.ndarray, q_rid: np.ndarray, x: np.ndarray, x_rid: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in one block, as far as they reach the k best scores
    `known` from other blocks; and the k best scores of both."""
    n, m = len(q), min(k, len(x))
    known = np.full((n, k), -np.inf) if known is None else known
    bound = [(statistics(q, s), statistics(x, s)) for s in LEVELS]
    coarse = bound[0][0] @ bound[0][1].T
    # by Cauchy and Schwarz the rounding of either resolution is far below this share of the product of lengths
    slack = 1e-9 * np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max()) + 1e-6
    coarse[q_rid[:, None] == x_rid[None, :]] = -np.inf
    least = known.min(1)
    if not np.isfinite(least).all():  # exact scores of the k best bounds give a first threshold
        first = np.argpartition(-coarse, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(n), m)
        seen = scores(q, x, rows, first.ravel()).astype(np.float64).reshape(n, m)
        seen[~np.isfinite(np.take_along_axis(coarse, first, 1))] = -np.inf
        least = best_of(k, known, seen).min(1)
    pair = (coarse >= least[:, None] - slack) & np.isfinite(coarse)
    del coarse
    cols = np.flatnonzero(pair.any(0))
    pair = pair[:, cols]
    fine_q, fine_x = bound[1][0], bound[1][1][cols]
    if np.count_nonzero(pair) * DENSE >= pair.size and fits(q, x):
        pair &= fine_q @ fine_x.T >= least[:, None] - slack
        all_scores = q @ x[cols].T
        a, b = np.nonzero(pair & (all_scores >= least[:, None]))
        s = all_scores[a, b].astype(np.int64)
    else:
        a, b = np.nonzero(pair)
        keep = products(fine_q, fine_x, a, b) >= least[a] - slack
        a, b = a[keep], b[keep]
        s = scores(q, x[cols], a, b) if len(a) else np.zeros(0, np.int64)
        keep = s >= least[a]
        a, b, s = a[keep], b[keep], s[keep]
    b = cols[b]
    order = np.lexsort((x_rid[b], ids[b], -s.astype(object) if len(s) and s.min() == _I64.min else -s, a))
    a, b, s = a[order], b[order], s[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, s, place = (z[place < k] for z in (a, b, s, place))
    own = np.full((n, k), -np.inf)
    own[a, place] = s
    return (a, b, s), best_of(k, known, own)


def group_top(q: np.ndarray, q_rid: np.ndarray, x: np.ndarray, x_rid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in a group."""
    out = []
    for i in range(0, len(q), ROWS):
        known, found = None, []
        for j in range(0, len(x), ROWS):
            (a, b, s), known = block_top(q[i : i + ROWS], q_rid[i : i + ROWS], x[j : j + ROWS], x_rid[j : j + ROWS], ids[j : j + ROWS], k, known)
            found.append((a, b + j, s))
        a, b, s = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.lexsort((x_rid[b], ids[b], -s.astype(object) if len(s) and s.min() == _I64.min else -s, a))
        a, b, s = a[order], b[order], s[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((a[best] + i, b[best], s[best]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


_FOUND = pa.schema([("q_rid", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def search(df: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, key, score. is_query: a condition on `id`."""
    good = f"`{vec}` IS NOT NULL AND size(`{vec}`) > 0 AND forall(`{vec}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = df.filter(good).filter(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), F.size(vec).alias("dim"), F.col(vec).cast("array<double>").alias("v"))
    rows = written(rows, "vectors")  # written, so that row numbers stay the same
    size = rows.agg(F.count("*").alias("n"), F.sum(8 * F.col("dim")).alias("b"), F.count_if(F.expr(is_query)).alias("nq"), F.sum(F.expr(f"CASE WHEN {is_query} THEN 8 * dim END")).alias("bq")).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_x = max(-(-(size.b or 0) // GROUP_BYTES), 1)
    # few candidate groups, so that a query's threshold serves long; small tables find work for all tasks by more query groups
    n_q = max(-(-(size.bq or 0) // GROUP_BYTES), min(QUERY_GROUPS, -(-tasks // n_x), -(-size.nq // 256)), 1)

    def dealt(r: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return r.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("dim", "x_group", "q_group")

    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.floor(SCALE * v).reshape(t.num_rows, -1), t["rid"].to_numpy(), t["id"].to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _FOUND.empty_table()
        (q, q_rid, q_id), (x, rid, ids) = vectors(left), vectors(right)
        a, b, s = group_top(q, q_rid, x, rid, ids, k)
        return pa.table([q_rid[a], q_id[a], rid[b], ids[b], s], schema=_FOUND)

    met = dealt(rows.filter(is_query), "q_group", n_q, "x_group", n_x).cogroup(dealt(rows, "x_group", n_x, "q_group", n_q))
    best = met.applyInArrow(run, "q_rid long, query_id long, rid long, id long, score long")
    best = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, id, rid)")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE = """WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, e.v) DESC, e.vec_id) AS rank FROM good q, good e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 20"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), "id % 20 = 0")
