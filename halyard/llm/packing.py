"""Packing into optimal length buckets (operator 2).

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that minimise the padding exactly; then batches of
at most `budget` padded tokens form inside each bucket, in key order. The histogram has every distinct length up to the budget, so
it is bounded by the budget (65,537 rows) whatever the corpus. A document longer than the budget is a batch of its own, in a last
bucket in which every row has its own length and no padding; nothing is cut or dropped.

Ranks inside buckets come from a range partitioning by (bucket, key, length, row number) and per-partition counts, so neither a
bucket nor a key that holds most rows is gathered in one task. Null and empty texts have length 0. Rows that repeat a key are packed
as separate rows, the shorter one first; rows equal in both are alike in the result. Null keys come first. Other columns are not
read, so their names do not matter. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import read, written

BUCKETS = 16
BUDGET = 65536


def byte_length(text: str = "text") -> Column:
    """Tokens of a byte-level model: one per UTF-8 byte."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def choose_boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """The at most k boundaries, among the ascending lengths, that minimise the sum of count times the covering boundary.

    With r buckets over the first j + 1 lengths, the last bucket starting at i costs before[i] + lengths[j] * (upto[j + 1] - upto[i]):
    for each i a line in lengths[j]. Slopes fall with i and lengths rise, so the lower hull is walked once a bucket: k * n steps.
    Among equal costs the smallest i is taken.
    """
    n, upto = len(lengths), [0]
    for c in counts:
        upto.append(upto[-1] + c)
    if not n:
        return []
    best, back = [e * upto[j + 1] for j, e in enumerate(lengths)], []
    for r in range(1, min(k, n)):
        new, start = [0] * n, [0] * n
        hull, at = [], 0  # (slope, intercept, i), the best line for ever larger lengths
        for j in range(r, n):
            m, b = -upto[j], best[j - 1]
            while len(hull) - at >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, b, j))
            e = lengths[j]
            while len(hull) - at >= 2 and hull[at + 1][0] * e + hull[at + 1][1] < hull[at][0] * e + hull[at][1]:
                at += 1
            m, b, start[j] = hull[at]
            new[j] = b + e * (upto[j + 1] + m)
        best = new
        back.append(start)
    out, j = [lengths[-1]], n - 1
    for start in reversed(back):
        j = start[j] - 1
        out.append(lengths[j])
    return out[::-1]


def ranked(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds `at`: the row's place, from 0, inside its group by the order, which must be total; no group is gathered in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(n, group, *order).withColumn("__p", F.spark_partition_id()), label)
    sizes = cut.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.expr(f"sum(__n) OVER (PARTITION BY `{group}` ORDER BY __p) - __n")).drop("__n")  # one row per partition and group
    keys = ", ".join(f"`{o}`" for o in order)
    own = cut.withColumn("__own", F.expr(f"row_number() OVER (PARTITION BY __p, `{group}` ORDER BY {keys}) - 1"))
    return own.join(before, [group, "__p"]).withColumn("at", F.expr("CAST(__own + __before AS BIGINT)")).drop("__p", "__own", "__before")


def pack(df: DataFrame, key: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, n_tokens, bucket, bucket_length, batch_id, position, padding per row."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), (byte_length() if length is None else length).alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "lengths")  # written, so that row numbers stay the same
    hist = sorted((r.length, r.c) for r in rows.groupBy(F.least("n", F.lit(budget + 1)).alias("length")).agg(F.count("*").alias("c")).collect())  # at most budget + 2 rows
    alone = hist.pop()[1] if hist and hist[-1][0] > budget else 0
    bounds = choose_boundaries([e for e, _ in hist], [c for _, c in hist], buckets)
    counts = [0] * len(bounds)
    for e, c in hist:
        counts[next(i for i, b in enumerate(bounds) if e <= b)] += c
    plan_rows, start = [], 0
    for i, (b, c) in enumerate(zip([*bounds, None], [*counts, alone], strict=True)):
        per = 1 if b is None else budget // max(1, b)
        plan_rows.append((i, b, start, per))
        start += -(-c // per)
    plan = spark.createDataFrame(plan_rows, "bucket int, bucket_length long, start long, per long")  # one row per bucket
    rows = rows.withColumn("bucket", F.expr(" + ".join(f"int(n > {b}L)" for b in bounds) or "0").cast("int"))
    out = ranked(rows, "bucket", ["k", "n", "row"], "ranks").join(F.broadcast(plan), "bucket")
    out = out.withColumn("bucket_length", F.coalesce("bucket_length", "n"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), "bucket", "bucket_length", F.expr("start + at div per").alias("batch_id"), F.expr("at % per").alias("position"), (F.col("bucket_length") - F.col("n")).alias("padding"))


def oracle(documents: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL of op2_packing: the same programme, a layer for each bucket and every start tried."""
    layers = ["l1 AS MATERIALIZED (SELECT 1 AS r, j, e * upto AS cost, CAST(0 AS BIGINT) AS i FROM hist)"]
    layers += [
        f"l{r} AS MATERIALIZED (SELECT {r} AS r, j, b.cost, b.i FROM (SELECT h.j, min({{'cost': p.cost + h.e * (h.upto - g.upto), 'i': p.j}}) AS b FROM hist h JOIN l{r - 1} p ON p.j < h.j JOIN hist g ON g.j = p.j GROUP BY h.j))" for r in range(2, buckets + 1)
    ]
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM {documents}),
hist AS MATERIALIZED (SELECT n AS e, CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS upto, row_number() OVER (ORDER BY n) AS j FROM (SELECT n, count(*) AS c FROM docs WHERE n <= {budget} GROUP BY n)),
{", ".join(layers)},
every AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM l{r}" for r in range(1, buckets + 1))}),
walk AS (SELECT r, j, i FROM every WHERE j = (SELECT max(j) FROM hist) AND r = least({buckets}, (SELECT max(j) FROM hist)) UNION ALL SELECT every.r, every.j, every.i FROM walk JOIN every ON every.r = walk.r - 1 AND every.j = walk.i),
bounds AS MATERIALIZED (SELECT walk.r - 1 AS bucket, e AS bucket_length FROM walk JOIN hist USING (j)),
placed AS MATERIALIZED (SELECT doc_id, n, coalesce((SELECT min(bucket) FROM bounds WHERE bucket_length >= n), (SELECT count(*) FROM bounds)) AS bucket FROM docs),
sized AS (SELECT p.*, coalesce(b.bucket_length, p.n) AS bucket_length, CASE WHEN b.bucket_length IS NULL THEN 1 ELSE {budget} // greatest(1, b.bucket_length) END AS per FROM placed p LEFT JOIN bounds b USING (bucket)),
starts AS (SELECT bucket, sum(batches) OVER (ORDER BY bucket) - batches AS start FROM (SELECT bucket, (count(*) + any_value(per) - 1) // any_value(per) AS batches FROM sized GROUP BY bucket)),
spots AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n) - 1 AS spot FROM sized)
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_length, CAST(start + spot // per AS BIGINT) AS batch_id, CAST(spot % per AS BIGINT) AS position, bucket_length - n AS padding FROM spots JOIN starts USING (bucket)"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
