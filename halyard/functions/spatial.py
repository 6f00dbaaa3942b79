"""Spatial expressions over STRUCT<lat: DOUBLE, lon: DOUBLE>; latitude comes first everywhere.

Distances are haversine metres on a sphere of EARTH_KM, or plain degrees for the euclidean metric.
"""

import math

EARTH_KM = 6371.0
EUCLIDEAN = {"euclidean", "euclidiana", "l2"}


def point(lat: str, lon: str) -> str:
    """A checked point; a coordinate outside its range raises an error."""
    bad = f"abs(CAST({lat} AS DOUBLE)) > 90 OR abs(CAST({lon} AS DOUBLE)) > 180"
    return f"(CASE WHEN {bad} THEN raise_error('coordinate out of range') ELSE named_struct('lat', CAST({lat} AS DOUBLE), 'lon', CAST({lon} AS DOUBLE)) END)"


def point_from_text(x: str) -> str:
    """`POINT(lat lon)`, `POINT(lat, lon)` or `lat,lon` or `lat lon`; null when it does not parse or is out of range."""
    number = r"[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pattern = rf"^\\s*(?:(?i:point)\\s*\\()?\\s*({number})\\s*[,\\s]\\s*({number})\\s*\\)?\\s*$"
    lat, lon = (f"try_cast(regexp_extract({x}, '{pattern}', {k}) AS DOUBLE)" for k in (1, 2))
    return f"(CASE WHEN abs({lat}) <= 90 AND abs({lon}) <= 180 THEN named_struct('lat', {lat}, 'lon', {lon}) END)"


def point_to_text(p: str) -> str:
    return f"(CASE WHEN ({p}) IS NOT NULL THEN concat('POINT(', CAST(({p}).lat AS STRING), ' ', CAST(({p}).lon AS STRING), ')') END)"


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"(2 * {EARTH_KM}D * atan2(sqrt({h}), sqrt(greatest(0D, 1 - {h}))) * 1000)"


def euclidean_deg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"sqrt(power(({lat2}) - ({lat1}), 2) + power(({lon2}) - ({lon1}), 2))"


def distance(p: str, q: str, metric: str = "haversine") -> str:
    """Null if either point is null."""
    f = euclidean_deg if metric.lower() in EUCLIDEAN else haversine_m
    return f(f"({p}).lat", f"({p}).lon", f"({q}).lat", f"({q}).lon")


def radius_box(lat: str, lon: str, centre: tuple[float, float], metres: float) -> str:
    """A range predicate on plain columns that holds for every point within `metres`, so Parquet can skip row groups.

    Longitude is unbounded when the circle touches a pole or crosses the antimeridian.
    """
    c_lat, c_lon = centre
    d = math.degrees(max(metres, 0.0) / (EARTH_KM * 1000)) * (1 + 1e-9) + 1e-9
    lo, hi = c_lat - d, c_lat + d
    box = f"({lat}) BETWEEN {lo!r}D AND {hi!r}D"
    if lo > -90 and hi < 90:
        s = math.sin(math.radians(d)) / math.cos(math.radians(c_lat))
        w = math.degrees(math.asin(min(1.0, s))) + 1e-9
        if s < 1 and c_lon - w >= -180 and c_lon + w <= 180:
            box += f" AND ({lon}) BETWEEN {c_lon - w!r}D AND {c_lon + w!r}D"
    return f"({box})"


def degree_box(lat: str, lon: str, centre: tuple[float, float], degrees: float) -> str:
    d = degrees + 1e-9
    return f"(({lat}) BETWEEN {centre[0] - d!r}D AND {centre[0] + d!r}D AND ({lon}) BETWEEN {centre[1] - d!r}D AND {centre[1] + d!r}D)"


def polygon_box(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    return f"(({lat}) BETWEEN {min(lats)!r}D AND {max(lats)!r}D AND ({lon}) BETWEEN {min(lons)!r}D AND {max(lons)!r}D)"


def _edge(lat: str, lon: str, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """(crosses the ray, lies on the segment) for one edge."""
    (y1, x1), (y2, x2) = a, b
    cross = f"((({lat}) - {y1}) * ({x2} - {x1}) - (({lon}) - {x1}) * ({y2} - {y1}))"
    on = f"({cross} = 0 AND ({lat}) BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}) AND ({lon}) BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}))"
    ray = f"((({y1} > ({lat})) <> ({y2} > ({lat}))) AND ({lon}) < {x1} + ({x2} - {x1}) * (({lat}) - {y1}) / nullif({y2} - {y1}, 0D))"
    return f"coalesce({ray}, false)", on


def within_ring(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    """Even-odd rule for a constant ring, boundary included; a null point is outside. Unrolled, so it stays in codegen."""
    if len(ring) < 3:
        raise ValueError("a polygon needs at least 3 points")
    edges = [_edge(lat, lon, tuple(f"({v!r}D)" for v in a), tuple(f"({v!r}D)" for v in b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    odd = " + ".join(f"int({ray})" for ray, _ in edges)
    return f"coalesce(({' OR '.join(on for _, on in edges)}) OR ({odd}) % 2 = 1, false)"


def within_array(lat: str, lon: str, ring: str) -> str:
    """The same rule for a ring held in an ARRAY<STRUCT<lat, lon>> column."""
    nxt = f"concat(slice({ring}, 2, size({ring}) - 1), slice({ring}, 1, 1))"
    ray, on = _edge(lat, lon, ("e.a.lat", "e.a.lon"), ("e.b.lat", "e.b.lon"))
    edges = f"zip_with({ring}, {nxt}, (a, b) -> named_struct('a', a, 'b', b))"
    return f"coalesce(exists({edges}, e -> {on}) OR size(filter({edges}, e -> {ray})) % 2 = 1, false)"
