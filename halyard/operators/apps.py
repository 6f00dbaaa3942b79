"""Interval merge and coverage of matched segments, and audio segmentation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_hits(hits: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Best hit of each query segment with score >= threshold. hits: segment_id, track_id, start_ms, end_ms, score."""
    w = Window.partitionBy("segment_id").orderBy(F.desc("score"), "track_id", "start_ms")
    return hits.filter(F.col("score") >= threshold).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def merge_intervals(df: DataFrame, group: str, start: str = "start_ms", end: str = "end_ms", gap: float = 1e-6, slice_width: float = 600_000.0) -> DataFrame:
    """Union of the intervals of each group: overlapping, or at most `gap` apart, become one.

    A group is cut into slices of time by the interval's start. Windows run inside a slice; from one slice to the next only how far the
    intervals reach and where the last run began is carried, one row a slice, so that no task holds a whole group.
    """
    rows = df.filter(f"{start} IS NOT NULL AND {end} IS NOT NULL").select(F.col(group).alias("g"), F.col(start).alias("s"), F.col(end).alias("e"), F.floor(F.col(start) / slice_width).alias("slice"))
    inside, earlier = Window.partitionBy("g", "slice").orderBy("s", "e"), Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(x: DataFrame, value, name: str) -> DataFrame:
        """Adds the largest value of the group's earlier slices."""
        slices = x.groupBy("g", "slice").agg(F.max(value).alias("m")).withColumn(name, F.max("m").over(earlier)).select(F.col("g").alias("g2"), F.col("slice").alias("slice2"), name)
        return x.join(slices, F.col("g").eqNullSafe(F.col("g2")) & (F.col("slice") == F.col("slice2"))).drop("g2", "slice2")

    rows = carried(rows, F.col("e"), "before")
    reach = F.greatest(F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))  # greatest skips nulls
    rows = rows.withColumn("reach", reach).withColumn("first", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + gap), F.col("s")))
    rows = carried(rows, F.col("first"), "run")
    upto = Window.partitionBy("g", "slice").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal intervals together
    run = F.coalesce(F.max("first").over(upto), F.col("run"))
    return rows.withColumn("run", run).groupBy("g", "run").agg(F.min("s").alias(start), F.max("e").alias(end)).select(F.col("g").alias(group), start, end)


#: Hits of a track, about, that are added up in one go.
RUN = 10_000


def ordered_sums(best: DataFrame) -> DataFrame:
    """(track_id, total): scores added up in the order of the segments, so that the last digits do not hang on how rows are dealt. Tracks of
    more than RUN hits are cut into parts by hash, each added up in order, and then the parts. best: track_id, segment_id, score, hits."""

    def total(of: str) -> Column:
        return F.expr(f"aggregate(transform(array_sort(collect_list(struct({of}))), x -> x.score), 0D, (s, x) -> s + x)").alias("score")

    part = F.expr(f"pmod(xxhash64(segment_id), 1 + hits DIV {RUN})").alias("part")
    parts = best.select("track_id", "segment_id", F.col("score").cast("double").alias("score"), part).groupBy("track_id", "part").agg(total("segment_id, score"))
    return parts.groupBy("track_id").agg(total("part, score")).withColumnRenamed("score", "total")


def exact_mean() -> Column:
    """Mean of the scores as they are written in decimal (0.98, not the double beside it): whatever the order of rows, without rounding errors.
    24 digits after the point are kept. With a score that is no such decimal (10,000 or more, NaN, infinite) it is the mean of doubles."""
    exact = F.expr("try_cast(score AS DECIMAL(28, 24))")
    return F.when(F.count(exact) == F.count("score"), (F.sum(exact) / F.count("score")).cast("double")).otherwise(F.avg("score"))


def match_tracks(hits: DataFrame, tracks: DataFrame, threshold: float = 0.98, exact: bool = False) -> DataFrame:
    """Per track: hits, covered time, coverage in percent, mean and maximum score. tracks: track_id, duration_ms. exact: the mean is that of
    the scores' decimals (exact_mean), so that one that ends in 5 rounds up; else doubles are added up in the order of the segments."""
    best = best_hits(hits, threshold)
    cover = merge_intervals(best, "track_id").groupBy("track_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    figures = [F.count("*").alias("hits"), F.max("score").alias("max_score")]
    if exact:
        score = best.groupBy("track_id").agg(*figures, exact_mean().alias("mean_score"))
    else:
        score = best.groupBy("track_id").agg(*figures)
        score = score.join(ordered_sums(best.join(score, "track_id")), "track_id").withColumn("mean_score", F.col("total") / F.col("hits"))
    pct = F.expr("least(100D, 100D * covered_ms / nullif(duration_ms, 0))").alias("coverage")
    return score.join(cover, "track_id").join(tracks.select("track_id", "duration_ms"), "track_id").select("track_id", "hits", "covered_ms", pct, "mean_score", "max_score")


def segment_offsets(df: DataFrame, window: float = 5.0, hop: float = 2.5, seconds: str = "seconds") -> DataFrame:
    """One row per window of each recording; the last window ends with the recording; shorter recordings have none."""
    last = f"({seconds} - {window})"
    starts = f"CASE WHEN {seconds} >= {window} THEN array_distinct(concat(transform(sequence(0, CAST(floor({last} / {hop}) AS INT)), i -> CAST(i * {hop} AS DOUBLE)), array(CAST({last} AS DOUBLE)))) END"
    return df.withColumn("start", F.explode(F.expr(starts))).withColumn("end", F.col("start") + window)


def envelope(samples: DataFrame, blocks: int = 420) -> DataFrame:
    """Block maxima of the absolute amplitude, scaled by the peak. samples: track_id, i, n, x."""
    b = samples.groupBy("track_id", F.expr(f"least({blocks - 1}, CAST(floor(i * {blocks} / n) AS INT))").alias("block")).agg(F.max(F.abs("x")).alias("m"))
    peak = b.groupBy("track_id").agg(F.max("m").alias("peak"))
    return b.join(peak, "track_id").select("track_id", "block", F.expr("CASE WHEN peak > 0 THEN m / peak ELSE 0D END").alias("level"))
