"""Exact and inverted-list vector search."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from halyard.functions import vector as V


def _array(q) -> str:
    return V.literal([repr(float(x)) for x in q])


def nearest(df: DataFrame, query, k: int, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Exact k nearest of one query vector, ties by key; a bounded heap per partition."""
    return df.filter(f"{vec} IS NOT NULL").withColumn("distance", F.expr(V.distance(vec, _array(query), metric))).orderBy("distance", key).limit(k)


#: Bytes of vectors, as doubles, in a block of queries or of rows; each pair of blocks is one cogroup.
BLOCK_BYTES = 16 << 20
#: Rows of a block in a table too small to fill all tasks with larger ones.
BLOCK_ROWS = 4096
#: Pairs of a query and a row that a matrix product scores at a time, and pairs whose distances are computed at a time.
PAIRS, EXACT = 1 << 21, 1 << 15


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, dimension) doubles, and which vectors hold a null component."""
    v = pa.concat_arrays(column.chunks)
    sizes = pc.list_value_length(v).to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vector dimensions differ")
    flat = v.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(v), sizes[0])
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(v), sizes[0]), null.any(1)


def _distances(q: np.ndarray, x: np.ndarray, rest: list, metric: str) -> np.ndarray:
    """Distances of the rows of q and x, with the products added up one after the other as V.distance does. rest: norms, null flags."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        z = x[:, j] - q[:, j] if metric == "euclidean" else x[:, j]
        total += z * (z if metric == "euclidean" else q[:, j])
    if metric != "cosine":
        return np.sqrt(total) if metric == "euclidean" else -total
    q_norm, x_norm, q_null, x_null = rest
    length = x_norm * q_norm
    return np.where(q_null | x_null | (length == 0), 1.0, 1 - total / np.where(length == 0, 1.0, length))


def block_nearest(q: np.ndarray, q_null: np.ndarray, q_code: np.ndarray, x: np.ndarray, x_null: np.ndarray, x_code: np.ndarray, k: int, metric: str, step: float, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of all rows of a block that can be among a query's k nearest by distance rounded to `step`, ties by code.

    A matrix product bounds all distances from both sides; the distances of those that the k-th upper bound leaves are computed as
    V.distance does. Of equal distances the k smallest codes stay.
    """
    q_norm, x_norm = (np.sqrt(sum((z[:, j] * z[:, j] for j in range(z.shape[1])), np.zeros(len(z)))) for z in (q, x))
    # vectors without bounds: null or non-finite components, or squares beyond the range of doubles
    q_odd, x_odd = (~((n == 0) & ~(z != 0).any(1) | (n > 1e-140) & (n < 1e140)) for n, z in ((q_norm, q), (x_norm, x)))
    slack = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps
    q_unit, x_unit = (np.where(odd[:, None], 0.0, z / np.where(odd | (n == 0), 1.0, n)[:, None] if metric == "cosine" else z) for z, n, odd in ((q, q_norm, q_odd), (x, x_norm, x_odd)))
    q_len, x_len = np.where(q_odd, 0.0, q_norm), np.where(x_odd, 0.0, x_norm)
    own = np.isin(q_code, x_code) if skip_self else np.zeros(len(q), bool)
    out = []
    size = max(1, PAIRS // len(x))
    for at in range(0, len(q), size):
        rows = slice(at, at + size)
        low = -(q_unit[rows] @ x_unit.T)
        if metric == "cosine":
            error = slack
        elif metric == "dot":
            error = slack * q_len[rows, None] * x_len
        else:  # bounds of the squared distance
            low = q_len[rows, None] ** 2 + x_len**2 + 2 * low
            error = slack * (q_len[rows, None] + x_len) ** 2
        high = low + error
        low -= error
        for z, v in ((low, -np.inf), (high, np.inf)):
            z[q_odd[rows]] = v
            z[:, x_odd] = v
        mine = [(i, x_code == q_code[at + i]) for i in np.flatnonzero(own[rows])]
        for i, same in mine:
            high[i, same] = np.inf
        kth = np.partition(high, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(low), np.inf)
        limit = (np.sqrt(np.maximum(kth, 0)) + step) ** 2 * (1 + slack) if metric == "euclidean" else kth + step
        keep = low <= limit[:, None]
        for i, same in mine:
            keep[i, same] = False
        a, b = np.nonzero(keep)
        del low, high, keep
        a += at
        parts = (slice(i, i + EXACT) for i in range(0, len(a), EXACT))
        d = np.concatenate([np.zeros(0), *(_distances(q[a[p]], x[b[p]], [q_norm[a[p]], x_norm[b[p]], q_null[a[p]], x_null[b[p]]], metric) for p in parts)])
        order = np.lexsort((x_code[b], d, a))
        a, b, d = a[order], b[order], d[order]
        place = np.arange(len(a))
        start = np.searchsorted(a, a)
        last = np.minimum(start + k, np.searchsorted(a, a, "right")) - 1
        fresh = (place == start) | ~((d == np.roll(d, 1)) | np.isnan(d) & np.isnan(np.roll(d, 1)))
        among_equals = place - np.maximum.accumulate(np.where(fresh, place, 0))
        keep = (among_equals < k) & ~(d > d[last] + step)
        out.append((a[keep], b[keep], d[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def nearest_join(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id", digits: int = 9, skip_self: bool = False) -> DataFrame:
    """(query_id, key, distance, rank) for a stated query set against all rows, or all but the query's own. queries: query_id, q.

    Rows rank by distance rounded to `digits`, ties by key; the distance itself is not rounded. Rows and queries are dealt into blocks of
    BLOCK_BYTES at most, and each pair of blocks is one cogroup, so that neither side is broadcast or collected. A query without
    vector has no distances; its rows are the first by key.
    """
    metric, spark = V.metric_name(metric), df.sparkSession
    asked, rows = queries.select("query_id", "q"), df.select(key, vec).filter(f"{vec} IS NOT NULL")
    if skip_self:
        asked, rows = asked.filter("query_id IS NOT NULL"), rows.filter(F.col(key).isNotNull())
    qs = asked.agg(F.sum(16 + 8 * F.size("q")).alias("bytes"), F.count_if(F.col("q").isNull()).alias("empty")).first()
    xs = rows.agg(F.sum(16 + 8 * F.size(vec)).alias("bytes"), F.count("*").alias("n")).first()
    n_q = max(1, -(-(qs.bytes or 0) // BLOCK_BYTES))
    n_x = max(1, -(-(xs.bytes or 0) // BLOCK_BYTES), min(-(-xs.n // BLOCK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = 1.001 * 10.0**-digits

    def dealt(r: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return r.withColumn(own, F.pmod(F.xxhash64(*r.columns), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("x_block", "q_block")

    kind = asked.schema["query_id"].dataType, rows.schema[key].dataType
    schema = StructType([StructField("query_id", kind[0]), StructField(key, kind[1]), StructField("distance", DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([left["query_id"].slice(0, 0), right[key].slice(0, 0), pa.array([], pa.float64())], names=schema.names)
        order = pc.sort_indices(right, [(key, "ascending")], null_placement="at_start")
        right = right.take(order)
        keys = pa.concat_arrays(right[key].chunks)
        values = pc.unique(keys)
        x_code = pc.index_in(keys, values).to_numpy(zero_copy_only=False)
        q_code = pc.fill_null(pc.index_in(left["query_id"].cast(keys.type), values), -1).to_numpy()
        with np.errstate(all="ignore"):
            a, b, d = block_nearest(*_matrix(left["q"]), q_code, *_matrix(right[vec]), x_code, k, metric, step, skip_self)
        return pa.table([left["query_id"].take(pa.array(a)), keys.take(pa.array(b)), pa.array(d)], names=schema.names)

    met = dealt(asked.filter("q IS NOT NULL"), "q_block", n_q, "x_block", n_x).cogroup(dealt(rows, "x_block", n_x, "q_block", n_q))
    d = met.applyInArrow(run, schema)
    if qs.empty:
        first = rows.select(key).orderBy(key).limit(k + 1)  # one of them may be the query's own
        none = asked.filter("q IS NULL").crossJoin(F.broadcast(first)).select("query_id", key, F.lit(None).cast("double").alias("distance"))
        d = d.unionByName(none.filter(F.col(key) != F.col("query_id")) if skip_self else none)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", digits), key)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Rows per list, at most about, that the cells are fitted on; every row is put into a list.
SAMPLE = 256


class IVF:
    """Inverted lists: k-means cells fitted on a bounded sample, all rows tagged with `list_id`, queries read only the probed lists."""

    def __init__(self, df: DataFrame, nlist: int | None = None, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id", seed: int = 1):
        self.metric, self.vec, self.key = V.metric_name(metric), vec, key
        if self.metric == "dot":
            raise ValueError("an inverted-list index does not take the dot product")
        rows = df.filter(f"{vec} IS NOT NULL")
        n = rows.count()
        self.nlist = min(max(2, nlist or math.isqrt(n)), 4096)
        train = rows.filter(f"{V.norm(vec)} > 0") if self.metric == "cosine" else rows
        share = min(1.0, SAMPLE * self.nlist / max(1, n))
        train = train.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**30)) < int(share * 2**30)).withColumn("__f", array_to_vector(F.col(vec).cast("array<double>")))
        model = KMeans(k=self.nlist, seed=seed, maxIter=100, tol=1e-4, featuresCol="__f", predictionCol="list_id", distanceMeasure=self.metric).fit(train)
        self.centroids = [c.tolist() for c in model.clusterCenters()]  # at most 4096
        self.lists = self.assigned(rows)

    @staticmethod
    def with_centroids(centroids: list, metric: str, vec: str, key: str) -> "IVF":
        ivf = IVF.__new__(IVF)
        ivf.metric, ivf.vec, ivf.key, ivf.centroids, ivf.nlist = V.metric_name(metric), vec, key, centroids, len(centroids)
        return ivf

    def assigned(self, rows: DataFrame) -> DataFrame:
        """Rows with the list_id of their nearest centroid. A zero vector has no direction; for the cosine it goes to list -1, which
        every query reads, and so does a null."""
        c = np.array(self.centroids)
        cosine = self.metric == "cosine"
        if cosine:
            c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None]
        half = np.zeros(len(c)) if cosine else (c * c).sum(1) / 2

        def nearest_list(v: pd.Series) -> pd.Series:
            out = np.full(len(v), -1, np.int32)
            some = [i for i, x in enumerate(v) if x is not None and (not cosine or np.any(x))]
            if some:
                out[some] = (np.stack([v[i] for i in some]).astype(np.float64) @ c.T - half).argmax(1)
            return pd.Series(out)

        nearest_list.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return rows.withColumn("list_id", F.pandas_udf(nearest_list, "int")(F.col(self.vec)))

    def save(self, path: str) -> "IVF":
        """Lists as Parquet partitions, so that a probe prunes at planning time."""
        self.lists.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
        self.lists = self.lists.sparkSession.read.parquet(path)
        return self

    def probes(self, query, nprobe: int) -> list[int]:
        q = [float(x) for x in query]
        if self.metric == "euclidean":
            d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in self.centroids]
        else:
            qn = math.hypot(*q)
            d = [1 - sum(a * b for a, b in zip(q, c, strict=True)) / ((qn * math.hypot(*c)) or 1.0) for c in self.centroids]
        return sorted(range(len(d)), key=lambda i: (d[i], i))[:nprobe]

    def search(self, query, k: int, nprobe: int = 1) -> DataFrame:
        lists = self.lists.filter(F.col("list_id").isin([-1, *self.probes(query, nprobe)]))
        return nearest(lists, query, k, self.metric, self.vec, self.key)

    def search_batch(self, queries: DataFrame, k: int, nprobe: int = 1, digits: int = 9) -> DataFrame:
        """(query_id, rank, key, distance) of a query set, each query in its nprobe nearest lists. queries: query_id, q."""
        asked = queries.filter("q IS NOT NULL").select("query_id", "q")
        cells = asked.sparkSession.createDataFrame(list(enumerate(self.centroids)), "list_id int, c array<double>")  # at most 4096
        far = F.coalesce(F.expr(V.distance("c", "q", self.metric)), F.lit(1.0)).alias("far")
        w = Window.partitionBy("query_id").orderBy("far", "list_id")
        probes = asked.crossJoin(cells).select("query_id", "q", "list_id", far).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= nprobe).select("query_id", "q", "list_id")
        probes = probes.unionByName(asked.withColumn("list_id", F.lit(-1)))
        pairs = self.lists.select(self.key, self.vec, "list_id").join(probes, "list_id")
        d = pairs.select("query_id", self.key, F.round(F.expr(V.distance(self.vec, "q", self.metric)), digits).alias("distance"))
        best = Window.partitionBy("query_id").orderBy("distance", self.key)
        return d.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", self.key, "distance")


def recall(found: DataFrame, exact: DataFrame, on: list[str]) -> DataFrame:
    """Share of the exact rows that were found."""
    both = exact.select(*on).join(found.select(*on).withColumn("hit", F.lit(1)), on, "left")
    return both.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def search(df: DataFrame, query=None, row=None, methods=("seq",), k: int = 10, metric: str = "cosine", nprobe: int | None = None, skip_recall: bool = False, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """method, rank, key, distance, score and recall for a query vector or the vector of a row.

    'hnsw' answers exactly: a graph walk is not distributed, and the exact heap has full recall.
    """
    q = query if query is not None else df.filter(F.col(key) == row).select(vec).first()[0]
    k = min(k, df.count())
    exact, out = nearest(df, q, k, metric, vec, key), None
    for m in methods:
        found = IVF(df, metric=metric, vec=vec, key=key) if m == "ivf" else None
        top = found.search(q, k, nprobe or max(1, round(found.nlist / 4))) if found else exact
        r = None if skip_recall else recall(top, exact, [key]).first()[0]
        part = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # at most k rows
        part = part.select(F.lit(m).alias("method"), "rank", key, "distance", F.expr(V.similarity("distance", metric)).alias("score"), F.lit(r).cast("double").alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


def items(df: DataFrame, limit: int = 2000, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows that hold a vector, a listing of at most `limit`."""
    return df.filter(f"{vec} IS NOT NULL").orderBy(key).limit(limit)


def identify(df: DataFrame, queries: DataFrame, threshold: float = 0.70, vec: str = "embedding", key: str = "vec_id", skip_self: bool = False) -> DataFrame:
    """Nearest sample of each query, accepted if its cosine reaches the threshold."""
    best = nearest_join(df, queries, 1, "cosine", vec, key, skip_self=skip_self)
    score = F.round(1 - F.round("distance", 9), 9)
    return best.select("query_id", key, score.alias("score"), (score >= threshold).alias("accepted"))


#: Rows, about, that get their numbers in one bucket.
BUCKET = 4096


def first_free(df: DataFrame, least: int, key: str = "vec_id") -> int:
    """The first key of made rows: after all real ones, `least` at least."""
    return max(least, (df.agg(F.max(key)).first()[0] or 0) + 1)


def scale_up(df: DataFrame, n: int, seed: int = 1, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The real rows first, then seeded bootstrap rows up to n: noisy positive components, clamped at 0, L2-normalised."""
    spark, have = df.sparkSession, df.count()
    cast = df.select(key, F.col(vec).cast("array<float>").alias(vec))
    if not have or n <= have:
        return cast
    # row numbers without one task for all: places inside buckets by the key's hash, plus the sizes of those before. Nothing here depends
    # on the numbers of partitions, which differ from one reading of the table to the next.
    bucket = F.expr(f"pmod(xxhash64({key}), {have // BUCKET + 1})")
    cut = df.select(F.col(key).alias("__k"), F.col(vec).cast("array<double>").alias("__v"), bucket.alias("__p"))
    before = cut.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.expr("sum(__n) OVER (ORDER BY __p) - __n"))  # one row per bucket
    base = cut.withColumn("__o", F.expr("row_number() OVER (PARTITION BY __p ORDER BY __k, __v)")).join(before, "__p").select(F.expr("__before + __o - 1").alias("__i"), "__v")
    first = first_free(df, have, key)
    extra = spark.range(first, first + n - have).withColumn("__i", F.expr(f"pmod(xxhash64(id, {seed}), {have})"))
    noisy = F.expr(f"transform(__v, (x, i) -> greatest(0D, CASE WHEN x > 0 THEN x * (1 + 0.03D * sqrt(-2 * ln((pmod(xxhash64(id, i, {seed}, 1), 1000003) + 1) / 1000004D)) * cos(2 * pi() * pmod(xxhash64(id, i, {seed}, 2), 1000003) / 1000003D)) ELSE x END))")
    made = extra.join(base, "__i").withColumn("__v", noisy).withColumn("__n", F.expr(V.norm("__v")))
    made = made.select(F.col("id").alias(key), F.expr("transform(__v, x -> CAST(x / nullif(__n, 0D) AS FLOAT))").alias(vec))
    return cast.unionByName(made)
