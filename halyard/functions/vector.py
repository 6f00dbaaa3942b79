"""Vector expressions over ARRAY<FLOAT>; every product is accumulated in double."""

METRICS = {n: m for m, names in {
    "euclidean": ("euclidean", "euclidiana", "euclidiana2", "l2"),
    "cosine": ("cosine", "coseno", "cos"),
    "dot": ("dot", "dot_product", "dotproduct", "producto_punto", "ip"),
}.items() for n in names}


def metric_name(name: str) -> str:
    try:
        return METRICS[name.strip("'\" ").lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}") from None


def literal(values) -> str:
    return f"array({', '.join(f'CAST({v} AS FLOAT)' for v in values)})"


def from_text(x: str) -> str:
    """`[1, 2]`, `(1 2)` or `1;2`; null when a part is not a finite number."""
    parts = f"filter(split(regexp_replace({x}, '[\\\\[\\\\]()]', ' '), '[,;\\\\s]+'), s -> s <> '')"
    vec = f"transform({parts}, s -> try_cast(s AS FLOAT))"
    return f"(CASE WHEN size({parts}) > 0 AND forall({vec}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < float('infinity')) THEN {vec} END)"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (s, v) -> s + v)"


def _same(a: str, b: str, x: str) -> str:
    return f"(CASE WHEN size({a}) <> size({b}) THEN raise_error('vector dimensions differ') ELSE {x} END)"


def dot(a: str, b: str) -> str:
    return _sum(f"zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE))")


def norm(a: str) -> str:
    return f"sqrt({_sum(f'transform({a}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))')})"


def distance(a: str, b: str, metric: str = "euclidean") -> str:
    """Ranking distance: L2; 1 - cosine, which is 1 if a norm is 0; or the negated inner product."""
    m = metric_name(metric)
    if m == "euclidean":
        body = f"sqrt({_sum(f'zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)))')})"
    elif m == "cosine":
        body = f"coalesce(1D - {dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0D), 1D)"
    else:
        body = f"(- {dot(a, b)})"
    return f"(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN {_same(a, b, body)} END)"


def similarity(d: str, metric: str) -> str:
    m = metric_name(metric)
    return {"cosine": f"(1D - {d})", "dot": f"(- {d})", "euclidean": f"(1D / (1D + {d}))"}[m]
