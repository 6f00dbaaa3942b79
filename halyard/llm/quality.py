"""Quality rules by distribution divergence (operator 5).

Each document's histogram of character classes and of its language's common words is compared with a reference per language by
Jensen-Shannon distance (base 2, 0 to 1). The references are counted over all documents of the corpus whose `lang` names one of
the languages in COMMON and that pass the base rules. A document is judged by its nearest language, also if it is in another.
Minimum lengths: the base rules reject texts under 50 words; of the others those under MIN_WORDS words are not judged by the
distance of characters, nor those under MIN_WORDS_FOR_WORDS by that of words, as short histograms are far from any reference.
Everything is built-in SQL functions, and one narrow table of counts is written between the two passes.

Repeated three-word windows are found by 64-bit hashes of the windows, so two different windows of one text count as equal with a
chance of 2^-64. A null or empty text has no words and fails the base rules. Texts are read whole, however long, and rows are judged
one by one, so repeated rows, ties and null ids are harmless; other columns are not read, so their names do not matter. Without
any reference (an empty corpus, no language labels) the method keeps what passes the base rules.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import SPACE_CLASS, read, written

#: A histogram of characters needs so many words.
MIN_WORDS = 80
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.29
#: A histogram of words needs more of them than one of characters.
MIN_WORDS_FOR_WORDS = 100
#: Up to so many distinct repeated windows are looked up in a list; more are found by sorting.
SHORT_LIST = 32

#: Common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "en": "the of and to in a is that for it as was with be by on".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
}

#: Character classes among ASCII capitals, digits and punctuation: a pattern of what is not in the class.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "mark": "[^.,;:!?()\\'\"-]+", "symbol": "[^#*$%&|<>]+"}
N_CLASSES = len(CLASSES) + 4


def common_words() -> list[str]:
    return sorted({w for ws in COMMON.values() for w in ws})


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The contract's base counts and both histograms as arrays, beside the rows' other columns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, __chars and __words.
    """
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__w", F.expr(f"filter(split(__t, '[{SPACE_CLASS}]+'), w -> w <> '')"))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.expr("CAST(length(array_join(__w, '')) AS BIGINT)"))
    df = df.withColumn("__x", F.expr("regexp_replace(__t, '[^!-Z\\\\[-`{-~]+', '')"))  # capitals, digits and punctuation are few
    for name, rest in CLASSES.items():
        df = df.withColumn(f"__{name}", F.expr(f"CAST(length(regexp_replace(__x, '{rest}', '')) AS BIGINT)"))
    df = df.withColumn("n_symbols", F.col("__symbol"))
    df = df.withColumn("__lines", F.expr(f"filter(split(__t, '\\n'), l -> l RLIKE '[^{SPACE_CLASS}]')"))
    df = df.withColumn("n_dup_lines", F.expr("CAST(size(__lines) - size(array_distinct(__lines)) AS BIGINT)"))

    df = df.withColumn("__h", F.expr("transform(slice(__w, 3, size(__w)), (x, i) -> xxhash64(__w[i], __w[i + 1], x))"))
    df = df.withColumn("__s", F.sort_array("__h"))
    df = df.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 AND x = __s[i - 1]))"))
    listed = "filter(transform(__h, (x, i) -> CASE WHEN array_contains(__d, x) THEN i ELSE -1 END), i -> i >= 0)"
    by_hash = "array_sort(transform(__h, (x, i) -> named_struct('h', x, 'i', i)))"
    # the inner transform binds the sorted list once
    by_sort = f"sort_array(element_at(transform(array({by_hash}), q -> transform(filter(transform(q, (e, k) -> named_struct('i', e.i, 'r', (k > 0 AND e.h = get(q, k - 1).h) OR coalesce(e.h = get(q, k + 1).h, false))), e -> e.r), e -> e.i)), 1))"
    df = df.withColumn("__p", F.expr(f"CASE WHEN size(__d) = 0 THEN CAST(array() AS ARRAY<INT>) WHEN size(__d) <= {SHORT_LIST} THEN {listed} ELSE {by_sort} END"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(__p, named_struct('n', 0L, 'at', 0), (s, x) -> named_struct('n', s.n + x + 3 - greatest(s.at, x), 'at', x + 3), s -> s.n)"))
    df = df.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))

    # small letters, white space, the rest of ASCII punctuation, and the extra bytes of letters beyond ASCII
    n, known = "CAST(length(__t) AS BIGINT)", [f"__{c}" for c in CLASSES]
    few = " + ".join(known)
    df = df.withColumn("__chars", F.expr(f"array({', '.join(known)}, word_chars - length(__x), {n} - word_chars, length(__x) - ({few}), CAST(octet_length(__t) AS BIGINT) - {n})"))
    words = ", ".join(f"'{w}'" for w in common_words())
    df = df.withColumn("__hits", F.expr(f"concat(' ', array_join(filter(__w, w -> w IN ({words})), '  '), ' ')"))
    padded = ", ".join(f"' {w} '" for w in common_words())
    df = df.withColumn("__words", F.expr(f"transform(array({padded}), c -> CAST((length(__hits) - length(replace(__hits, c, ''))) div length(c) AS BIGINT))"))
    own = {f.name for f in df.schema.fields if f.name.startswith("__")} - {"__chars", "__words", "__key", "__lang"}
    return df.drop(*own)


def _bins(words: str, total: str, lang: str) -> str:
    every = common_words()
    picked = [f"{words}[{every.index(w)}]" for w in COMMON[lang]]
    return f"array({', '.join(picked)}, greatest(0L, {total} - ({' + '.join(picked)})))"


def references(c: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Per language the shares of the character classes and of its common words and all others; one row a language comes back."""
    good = c.filter(~F.col("base_failed") & F.col(lang).isin(list(COMMON)))
    every, out = common_words(), {}
    n_c, n_w = N_CLASSES, len(every)
    sums = [F.sum(F.col("__chars")[i]).alias(f"c{i}") for i in range(n_c)] + [F.sum(F.col("__words")[i]).alias(f"w{i}") for i in range(n_w)]
    for r in good.groupBy(lang).agg(F.sum("n_words").alias("n"), *sums).collect():
        chars = [float(r[f"c{i}"]) for i in range(n_c)]
        picked = [float(r[f"w{every.index(w)}"]) for w in COMMON[r[lang]]]
        words = [*picked, max(0.0, float(r["n"]) - sum(picked))]
        out[r[lang]] = ([x / sum(chars) for x in chars], [x / sum(words) for x in words])
    return out


def js_distance(values: str, reference: list[float]) -> str:
    """Jensen-Shannon distance of an array of counts to fixed shares; 1 for an empty document."""
    ref = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    total = f"aggregate({values}, 0L, (s, x) -> s + x)"
    term = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0D END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0D END"
    pairs = f"zip_with(transform({values}, x -> x / CAST(t AS DOUBLE)), {ref}, (p, q) -> {term})"
    return f"element_at(transform(array({total}), t -> CASE WHEN t > 0 THEN sqrt(greatest(0D, 0.5D * aggregate({pairs}, 0D, (s, x) -> s + x))) ELSE 1D END), 1)"


def verdicts(c: DataFrame, refs: dict) -> DataFrame:
    """Adds lang_nearest, char_distance, word_distance (to the nearest language) and kept."""
    if not refs:
        return c.withColumns({"lang_nearest": F.lit(None).cast("string"), "char_distance": F.lit(0.0), "word_distance": F.lit(0.0), "kept": ~F.col("base_failed")})
    each: list[Column] = []
    for lang, (chars, words) in sorted(refs.items()):
        cd, wd = js_distance("__chars", chars), js_distance(_bins("__words", "n_words", lang), words)
        each.append(F.expr(f"named_struct('s', ({cd}) / {MAX_CHAR_DISTANCE} + ({wd}) / {MAX_WORD_DISTANCE}, 'l', '{lang}', 'c', {cd}, 'w', {wd})"))
    c = c.withColumn("__best", F.array_min(F.array(*each)))
    like = (F.col("n_words") < MIN_WORDS) | (F.col("__best.c") <= MAX_CHAR_DISTANCE)
    kept = ~F.col("base_failed") & like & ((F.col("n_words") < MIN_WORDS_FOR_WORDS) | (F.col("__best.w") <= MAX_WORD_DISTANCE))
    return c.withColumns({"lang_nearest": F.col("__best.l"), "char_distance": F.col("__best.c"), "word_distance": F.col("__best.w"), "kept": kept}).drop("__best")


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    c = written(counts(df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).alias("__lang")), "__text").drop("__text"), "quality")
    out = verdicts(c, references(c, "__lang"))
    return out.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lang_nearest", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), "kept")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL of op5_quality; windows are compared as words, not as hashes."""
    every = common_words()
    array = lambda xs: "[" + ", ".join(xs) + "]"
    known = {"upper": "[^A-Z]", "digit": "[^0-9]", "mark": "[^.,;:!?()''\"-]", "symbol": "[^#*$%&|<>]"}
    few = ", ".join(f"length(regexp_replace(t, '{rest}', '', 'g')) AS {name}" for name, rest in known.items())
    bins = " UNION ALL ".join(f"SELECT '{lang}' AS lang, {array([str(every.index(w) + 1) for w in ws])} AS picked" for lang, ws in sorted(COMMON.items()))
    distance = "sqrt(greatest(0, 0.5 * list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))))"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
base AS MATERIALIZED (SELECT rn, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) AS n, strlen(t) AS bytes, {few}, length(regexp_replace(t, '[^!-Z\\[-`{{-~]', '', 'g')) AS plain,
  list_transform({array([f"'{w}'" for w in every])}, lambda c: len(list_filter(w, lambda x: x = c))) AS hits, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT rn, count(DISTINCT j) AS r FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rn),
c AS MATERIALIZED (SELECT base.*, CAST(word_chars AS BIGINT) AS wc, len(lines) - len(list_distinct(lines)) AS dup, coalesce(r, 0) AS r, n_words < 50 OR 100 * coalesce(r, 0) > 50 * n_words AS bad,
  list_transform([upper, digit, mark, symbol, word_chars - plain, n - word_chars, plain - upper - digit - mark - symbol, bytes - n], lambda x: CAST(x AS DOUBLE)) AS chars FROM base LEFT JOIN rep USING (rn)),
bins AS ({bins}),
pos AS (SELECT c.rn, b.lang AS ref, c.bad, c.lang, c.chars, list_append(list_transform(b.picked, lambda k: CAST(c.hits[k] AS DOUBLE)), greatest(0, c.n_words - list_sum(list_transform(b.picked, lambda k: c.hits[k])))) AS words FROM c, bins b),
sums AS (SELECT ref, kind, i, sum(x) AS x FROM (SELECT ref, 'c' AS kind, unnest(range(1, len(chars) + 1)) AS i, unnest(chars) AS x FROM pos WHERE NOT bad AND lang = ref UNION ALL SELECT ref, 'w', unnest(range(1, len(words) + 1)), unnest(words) FROM pos WHERE NOT bad AND lang = ref) GROUP BY ALL),
refs AS (SELECT ref, kind, list(x / total ORDER BY i) AS q FROM (SELECT *, sum(x) OVER (PARTITION BY ref, kind) AS total FROM sums) GROUP BY ref, kind),
each AS (SELECT p.rn, p.ref, CASE WHEN list_sum(p.chars) > 0 THEN {distance.format(p="list_transform(p.chars, lambda x: x / list_sum(p.chars))", q="rc.q")} ELSE 1 END AS cd, CASE WHEN list_sum(p.words) > 0 THEN {distance.format(p="list_transform(p.words, lambda x: x / list_sum(p.words))", q="rw.q")} ELSE 1 END AS wd FROM pos p JOIN refs rc ON rc.ref = p.ref AND rc.kind = 'c' JOIN refs rw ON rw.ref = p.ref AND rw.kind = 'w'),
best AS (SELECT rn, min({{'s': cd / {MAX_CHAR_DISTANCE} + wd / {MAX_WORD_DISTANCE}, 'l': ref, 'c': cd, 'w': wd}}) AS b FROM each GROUP BY rn)
SELECT doc_id, n_words, wc AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, dup AS n_dup_lines, r AS n_repeat_words, bad AS base_failed, b.l AS lang_nearest, round(coalesce(b.c, 0), 6) AS char_distance, round(coalesce(b.w, 0), 6) AS word_distance,
  NOT bad AND (b IS NULL OR ((n_words < {MIN_WORDS} OR b.c <= {MAX_CHAR_DISTANCE}) AND (n_words < {MIN_WORDS_FOR_WORDS} OR b.w <= {MAX_WORD_DISTANCE}))) AS kept FROM c LEFT JOIN best USING (rn)"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
