"""Toxicity by a weighted lexicon and Aho-Corasick matching (operator 3).

Texts are folded first: compatibility forms and accents are removed, look-alike letters of other scripts, digits and symbols
become the Latin letters they stand for (i, l, 1 and | are one letter), everything else separates words. The lexicon holds whole
words and word beginnings that toxic texts hold more often than chance allows: a binomial tail probability, times the number of
patterns tried, below ALPHA (so less than one pattern is expected by chance), where copies of a text (two shared hashes among the SKETCH smallest of their three-word shingles)
count once. Matches inside an exception phrase do not count; phrases are fixed ones and those learned from clean texts. Weights are summed,
normalised by the length in words, and a small logistic model makes the score. It is fitted by cross-fitting: each fold of the
training rows is matched against a lexicon learned without it, so noise in the lexicon is seen as noise.

Learning reads at most about MAX_CLASS labelled rows and MAX_BYTES bytes of text a class, chosen by hash, and only rows outside the
held-out fold; an id with differing labels counts as toxic. Without rows of both classes the fixed lexicon below is used.

Null and empty texts score the model's value for no match. Each row is scored alone and as a whole, however long its text, so
repeated rows, ties and null ids (never held out) are harmless; other columns are not read, so their names do not matter. An
empty table gives no rows.
"""

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import shingles
from halyard.llm.common import fold, read, small_batches, tidy

MAX_CLASS = 4000
MAX_BYTES = 8 << 20
#: A pattern needs so many toxic texts, copies counted once, and that share of them.
MIN_DOCS, MIN_SHARE = 3, 0.01
MIN_STEM, MAX_STEM, MIN_FORMS = 4, 7, 3
MIN_LOG_ODDS = 3.0
ALPHA = 1.0
#: A phrase of two words is an exception if so many clean texts and no toxic text hold it.
MIN_EXCEPTION = 3
SKETCH, FOLDS = 3, 5

#: What stands for which letter, a starting lexicon, and phrases in which its words are harmless.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "n", "ο": "o", "ρ": "r", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i",
}
WORDS = "idiot moron clown loser scum trash stupid pathetic worthless disgusting".split()
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "class clown", "sore loser", "worthless check", "idiot proof"]


class _Fold(dict):
    def __missing__(self, c: int):
        ch = chr(c)
        out = None if unicodedata.category(ch) in ("Mn", "Cf") else ch if ch.isalpha() or ch.isdigit() else " "
        self[c] = out
        return out


_TABLE = _Fold({ord(a): b for a, b in LOOKALIKES.items()})
_TAIL = re.compile(r"[$@!|]+(?!\w)")


def folded(text: str | None) -> str:
    """Words separated and surrounded by single or more spaces."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
    if "$" in t or "@" in t or "!" in t or "|" in t:
        t = _TAIL.sub(" ", t)
    return f" {t.translate(_TABLE)} "


def groups(texts: list[str]) -> list[int]:
    """A number for each text, the same for copies and near copies: those that share two of their smallest shingle hashes."""
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    seen: dict[tuple, int] = {}
    for first, docs in shingles.chunks(texts):
        sets, n = shingles.shingle_sets(docs, 3)
        for i, (end, size) in enumerate(zip(np.cumsum(n), n, strict=True), first):
            least = sets[end - size : end - size + min(size, SKETCH)].tolist()
            for h in itertools.combinations(least, 2) if size > 1 else [tuple(least)] if size else []:
                root[find(i)] = find(seen.setdefault(h, i))
    return [find(i) for i in range(len(texts))]


def _tail(k: int, n: int, p: float) -> float:
    """Probability of k or more hits in n trials of chance p."""
    logs = (math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p) for x in range(k, n + 1))
    return sum(map(math.exp, logs))


def _patterns(words: set[str]) -> Iterator[str]:
    """The words, each with a space after it, and their beginnings."""
    for w in words:
        yield w + " "
        for k in range(MIN_STEM, min(MAX_STEM, len(w) - 1) + 1):
            yield w[:k]


def _counts(rows: list[tuple[list[str], int, int, int]]) -> tuple[list[list[Counter]], list[list[int]]]:
    """Per fold and class, the number of groups that hold a pattern, and of all groups, from (words, toxic, group, fold) rows.

    Toxic texts are counted first and clean ones only for what enough toxic ones hold, which bounds the memory.
    """
    held: dict[tuple[int, int, int], list] = {}
    for ws, y, g, f in rows:
        held.setdefault((y, f, g), []).append(ws)
    counts, sizes = [[Counter(), Counter()] for _ in range(FOLDS)], [[0, 0] for _ in range(FOLDS)]
    known: Counter = Counter()
    for y in (1, 0):
        for (k, f, _), parts in held.items():
            if k == y:
                found = _patterns({w for ws in parts for w in ws})
                counts[f][y].update(set(found) if y else {x for x in found if known[x] >= MIN_DOCS})
                sizes[f][y] += 1
        if y:
            for c in counts:
                known.update(c[1])
    return counts, sizes


def _lexicon(counts: list[list[Counter]], sizes: list[list[int]], toxic_words: set[str]) -> dict[str, float]:
    """{pattern: weight} from the counts of some folds."""
    n = [sum(s[y] for s in sizes) for y in (0, 1)]
    clean, toxic = Counter(), Counter()
    for c in counts:
        clean.update(c[0])
        toxic.update(c[1])
    chance, tried = n[1] / (n[0] + n[1]), sum(b > 1 for b in toxic.values())

    def odds(x: str) -> float:
        return math.log((toxic[x] + 0.1) / (n[1] + 0.2)) - math.log((clean[x] + 0.1) / (n[0] + 0.2))

    often = {x: b for x, b in toxic.items() if b >= max(MIN_DOCS, MIN_SHARE * n[1])}
    strong = {x for x, b in often.items() if odds(x) >= MIN_LOG_ODDS and b * n[0] >= 20 * clean[x] * n[1] and _tail(b, clean[x] + b, chance) * tried < ALPHA}
    forms: dict[str, set] = defaultdict(set)
    for w in toxic_words:
        for k in range(MIN_STEM, min(MAX_STEM, len(w) - 1) + 1):
            if w[:k] in strong:
                forms[w[:k]].add(w)
    lexicon: dict[str, float] = {}
    for s in sorted((s for s in strong if len(forms.get(s, ())) >= MIN_FORMS), key=lambda s: (len(s), s)):
        if not any(f" {s[:k]}" in lexicon for k in range(MIN_STEM, len(s))):
            lexicon[f" {s}"] = odds(s)
    for w in sorted(x for x in strong if x.endswith(" ")):
        if not any(f" {w[:k]}" in lexicon for k in range(MIN_STEM, len(w))):
            lexicon[f" {w}"] = odds(w)
    return lexicon | {p: MIN_LOG_ODDS for w in WORDS if (p := f" {folded(w).strip()} ") not in lexicon and not any(p.startswith(q) for q in lexicon)}


def _exceptions(rows: list[tuple[list[str], int, int, int]], lexicon: dict[str, float]) -> list[str]:
    """Phrases of a lexicon word and a neighbour that enough clean groups and no toxic one hold."""
    beginnings, hit = {p.strip() for p in lexicon}, {}
    phrases: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for ws, y, g, _ in rows:
        for i, w in enumerate(ws):
            if w not in hit:
                hit[w] = any(w[:k] in beginnings for k in range(1, len(w) + 1))
            if hit[w]:
                for j in (i - 1, i):
                    if 0 <= j < len(ws) - 1:
                        phrases[f"{ws[j]} {ws[j + 1]}"][y].add(g)
    return sorted(x for x, c in phrases.items() if len(c[0]) >= MIN_EXCEPTION and not c[1])


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps of a ridge-regularised logistic regression in which both classes weigh the same.

    The first feature is constant. More of any other never lowers a score: what would get a negative weight is left out.
    """
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    used = list(range(x.shape[1]))
    while True:
        z, w = x[:, used], np.zeros(len(used))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (weight * (p - y)) + 0.05 * w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if len(w) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out.tolist()
        del used[1 + int(w[1:].argmin())]


def learn(rows: list[tuple[str, int]]) -> dict:
    """The lexicon {pattern: weight}, exception phrases and logistic coefficients from (text, toxic) rows."""
    n = Counter(y for _, y in rows)
    out = {"toxic": n[1], "clean": n[0], "lexicon": {f" {folded(w).strip()} ": 1.0 for w in WORDS}, "exceptions": [], "model": [-4.0, 8.0, 0.5, 0.5]}
    if not (n[0] and n[1]):
        return out
    group = groups([t for t, _ in rows])
    toxic_groups = {g for (_, y), g in zip(rows, group, strict=True) if y}
    fold_of = {g: i % FOLDS for some in (toxic_groups, set(group) - toxic_groups) for i, g in enumerate(sorted(some))}  # copies are in one fold
    one: dict[str, str] = {}  # equal words are one object
    own = [([one.setdefault(w, w) for w in folded(t).split()], y, g, fold_of[g]) for (t, y), g in zip(rows, group, strict=True)]
    del one
    counts, sizes = _counts(own)
    toxic_words = {w for ws, y, _, _ in own if y for w in ws}
    x = np.empty((len(rows), 4))
    for k in range(FOLDS):
        rest = [f for f in range(FOLDS) if f != k]
        known = all(sum(sizes[f][y] for f in rest) for y in (0, 1))
        match = Matcher(out | {"lexicon": _lexicon([counts[f] for f in rest], [sizes[f] for f in rest], toxic_words)} if known else out)
        for i, r in enumerate(own):
            if r[3] == k:
                x[i] = match.features(rows[i][0])
    lexicon = _lexicon(counts, sizes, toxic_words)
    return out | {"lexicon": lexicon, "exceptions": _exceptions(own, lexicon), "model": _logistic(x, np.array([y for _, y in rows], float))}


class Matcher:
    def __init__(self, model: dict):
        self.model = model["model"]
        self.auto = ahocorasick.Automaton()
        for p, w in model["lexicon"].items():
            self.auto.add_word(p, (len(p), w))
        for p in {f" {' '.join(folded(e).split())} " for e in EXCEPTIONS} | {f" {e} " for e in model["exceptions"]}:
            self.auto.add_word(p, (len(p), None))
        self.auto.make_automaton()

    def hits(self, t: str) -> list[float]:
        found = [(end - n + 1, end, w) for end, (n, w) in self.auto.iter(t)]
        shields = [(a, b) for a, b, w in found if w is None]
        return [w for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in shields)]

    def features(self, text: str | None) -> list[float]:
        t = folded(text)
        total = sum(self.hits(t))
        if not total:
            return [1.0, 0.0, 0.0, 0.0]
        return [1.0, 1.0, math.log1p(total), min(10.0, 10 * total / (t.count(" ") + 1))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0) -> dict:
    small_batches(docs.sparkSession)
    pool = labels.select(F.col(key).cast("long").alias("k"), F.col(label).alias("y")).filter(F.col("y").isin(0, 1)).filter(fold("k", folds) != held_out)
    pool = pool.groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sizes = rows.select("k", F.octet_length("t").alias("b")).join(pool, "k").groupBy("y").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()  # two rows
    cut = F.lit(0)
    for r in sizes:
        cut = F.when(F.col("y") == r.y, int(min(1.0, MAX_CLASS / r.n, MAX_BYTES / max(1, r.b)) * 2**30)).otherwise(cut)
    chosen = pool.filter(F.pmod(F.xxhash64(F.lit(17), "k"), F.lit(2**30)) < cut)
    some = rows.join(F.broadcast(chosen), "k").collect()  # about 2 * MAX_CLASS rows and 2 * MAX_BYTES bytes
    return learn([(r.t, int(r.y)) for r in sorted(some)])


def scorer(model: dict, text: str = "text") -> Column:
    """Score of a text column; only that column goes through Python."""
    made: list[Matcher] = []

    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(model))
        out = pd.Series([made[0].score(t) for t in texts], dtype="float64")
        tidy()
        return out

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted per row."""
    model = train(docs, labels, key, text)
    out = docs.select(F.col(key).alias(key), F.coalesce(fold(key, 5) == 0, F.lit(False)).alias("held_out"), scorer(model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
