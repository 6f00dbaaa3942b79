"""Scalar helpers whose results differ from ANSI Spark: division, comparison with nulls, truthiness."""


def safe_div(a: str, b: str, integers: bool) -> str:
    """a / b with x / 0 = 0; integers divide with truncation towards zero. Null operands give null."""
    zero = f"({b}) = 0"
    if integers:
        return f"(CASE WHEN {zero} THEN CAST(0 AS BIGINT) ELSE (({a}) div nullif(({b}), 0)) END)"
    return f"(CASE WHEN {zero} THEN 0D ELSE CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0D) END)"


def cmp_total(a: str, op: str, b: str) -> str:
    """Two-valued comparison in which null equals null and sorts below every value."""
    if op == "=":
        return f"(({a}) <=> ({b}))"
    if op == "!=":
        return f"(NOT (({a}) <=> ({b})))"
    below = f"(CASE WHEN ({b}) IS NULL THEN false WHEN ({a}) IS NULL THEN true ELSE ({a}) < ({b}) END)"
    above = f"(CASE WHEN ({a}) IS NULL THEN false WHEN ({b}) IS NULL THEN true ELSE ({a}) > ({b}) END)"
    return {"<": below, ">": above, "<=": f"(NOT {above})", ">=": f"(NOT {below})"}[op]


def truthy(x: str, kind: str) -> str:
    """Truth of a value by its kind: bool, int, text, bytes, vector or float (a float is true when positive, as for MATCH)."""
    test = {"bool": f"({x})", "int": f"({x}) <> 0", "text": f"length({x}) > 0", "bytes": f"octet_length({x}) > 0", "vector": f"size({x}) > 0", "float": f"({x}) > 0"}[kind]
    return f"coalesce({test}, false)"
