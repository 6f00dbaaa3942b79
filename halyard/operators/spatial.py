"""Spatial searches over a DataFrame with latitude and longitude columns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import spatial as S


def locations(df: DataFrame, lat: str | None = "latitud", lon: str | None = "longitud", point: str | None = None) -> DataFrame:
    """id, nombre, tipo, lat, lon from a table with numeric or textual coordinates, or a point text column; bad rows are skipped."""
    if point:
        df = df.withColumn("__p", F.expr(S.point_from_text(f"`{point}`")))
        a, b = F.col("__p.lat"), F.col("__p.lon")
    else:
        a, b = F.expr(f"try_cast(trim(CAST(`{lat}` AS STRING)) AS DOUBLE)"), F.expr(f"try_cast(trim(CAST(`{lon}` AS STRING)) AS DOUBLE)")
    out = df.select("id", "nombre", "tipo", a.alias("lat"), b.alias("lon"))
    return out.filter("id IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180")


def _q(centre: tuple[float, float], metric: str, lat: str, lon: str) -> str:
    f = S.euclidean_deg if metric.lower() in S.EUCLIDEAN else S.haversine_m
    return f(lat, lon, f"{centre[0]!r}D", f"{centre[1]!r}D")


def within_radius(df: DataFrame, centre: tuple[float, float], radius: float, metric: str = "haversine", lat: str = "lat", lon: str = "lon", strict: bool = False) -> DataFrame:
    """Rows within `radius` metres (degrees if euclidean), with their `distance`. The box reaches the scan; the exact test follows."""
    if radius < 0:
        return df.withColumn("distance", F.lit(0.0)).filter("false")
    box = S.degree_box(lat, lon, centre, radius) if metric.lower() in S.EUCLIDEAN else S.radius_box(lat, lon, centre, radius)
    return df.filter(box).withColumn("distance", F.expr(_q(centre, metric, lat, lon))).filter(f"distance {'<' if strict else '<='} {radius!r}D")


def nearest(df: DataFrame, centre: tuple[float, float], k: int, metric: str = "haversine", lat: str = "lat", lon: str = "lon", key: str = "id") -> DataFrame:
    """The k nearest rows, ties by key: one heap per partition (TakeOrderedAndProject), no full sort."""
    return df.filter(f"{lat} IS NOT NULL AND {lon} IS NOT NULL").withColumn("distance", F.expr(_q(centre, metric, lat, lon))).orderBy("distance", key).limit(k)


def in_polygon(df: DataFrame, ring: list[tuple[float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.filter(S.polygon_box(lat, lon, ring)).filter(S.within_ring(lat, lon, ring))


def in_rectangle(df: DataFrame, low: tuple[float, float], high: tuple[float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.filter(F.col(lat).between(low[0], high[0]) & F.col(lon).between(low[1], high[1]))


def map_range(df: DataFrame, centre, radius: float, unit: str = "km") -> DataFrame:
    """Map search by kilometres or degrees, sorted by distance then id."""
    if unit == "degrees":
        return within_radius(df, centre, radius, "euclidean").orderBy("distance", "id")
    return within_radius(df, centre, radius * 1000).withColumn("distance", F.col("distance") / 1000).orderBy("distance", "id")


def map_knn(df: DataFrame, centre, k: int, max_distance: float | None = None, unit: str = "km") -> DataFrame:
    """Ranked neighbours from 1; distances in kilometres or degrees."""
    if k < 1:
        raise ValueError("k must be at least 1")
    near = nearest(df, centre, k, "euclidean" if unit == "degrees" else "haversine")
    near = near if unit == "degrees" else near.withColumn("distance", F.col("distance") / 1000)
    near = near if max_distance is None else near.filter(F.col("distance") <= max_distance)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # at most k rows


def map_polygon(df: DataFrame, ring) -> DataFrame:
    return in_polygon(df, ring).orderBy("id")


def grid_cells(df: DataFrame, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounding boxes and counts per grid cell, the counterpart of a tree's node dump."""
    cell = df.withColumn("cell_lat", F.floor(F.col(lat) / step)).withColumn("cell_lon", F.floor(F.col(lon) / step))
    return cell.groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))
