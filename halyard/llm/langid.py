"""Language identification by a bidirectional gated recurrent network over bytes (operator 8).

Each direction runs h = c + z * (h - c), z = clip(a / 4 + 1/2, 0, 1), c = clip(b, -1, 1), with [a, b] = table[byte] + h U: a gated unit
with hard nonlinearities, so inference is table look-ups and one small product per byte. It is trained in numpy by
backpropagation through time; every byte position gets a label distribution, and a document's probabilities are their mean.

A text is read whole, in windows of WINDOW bytes in which the states start at zero; the last window ends with the text and counts
only its new positions; shorter texts are padded with spaces that do not count. Training reads at most about
MAX_DOCS documents and MAX_BYTES bytes of text per language, chosen by hash, outside the held-out fold. Of their windows it draws
TRAIN_WINDOWS per language, with replacement, about 0.4 MB whatever the texts hold. A text that is null or has no letter is `und` with
score 0; without training rows every text is. Rows are judged alone and whole, however long their texts, so repeated rows, ties and
null ids (never held out, never learned from) are harmless; other columns are not read, so their names do not matter. An empty
table gives no rows.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import fold, read, small_batches, tidy

WINDOW = 128
HIDDEN = 8
MAX_DOCS = 500
MAX_BYTES = 4 << 20
TRAIN_WINDOWS = 3000
EPOCHS = 8
BATCH = 256
BLOCK = 4096
UND = "und"
#: No text is rejected for a share of strange byte pairs below this, however alike the training texts are.
LEAST_STRANGE = 0.25
_LETTER = re.compile(r"[^\W\d_]")


def _forward(rows: np.ndarray, p: dict, d: str, keep: bool = False):
    """States (T, B, H) of one direction, and what backpropagation needs."""
    b, t = rows.shape
    table, u = p[f"W{d}"], p[f"U{d}"]
    n = u.shape[0]
    h = np.zeros((b, n), u.dtype)
    out = np.empty((t, b, n), u.dtype)
    saved = []
    x = np.empty((b, 2 * n), u.dtype)
    for k in range(t):
        a = np.matmul(h, u)
        np.take(table, rows[:, k], axis=0, out=x)
        a += x
        az, ac = a[:, :n], a[:, n:]
        z = az * np.float32(0.25)
        z += np.float32(0.5)
        zc = np.minimum(np.maximum(z, 0), 1)
        c = np.minimum(np.maximum(ac, -1), 1)
        if keep:
            saved.append((h, zc, c, (z > 0) & (z < 1), np.abs(ac) < 1))
        h = h - c
        h *= zc
        h += c
        out[k] = h
    return out, saved


def _backward(rows: np.ndarray, p: dict, d: str, saved: list, dout: np.ndarray) -> dict:
    b, t = rows.shape
    u = p[f"U{d}"]
    n = u.shape[0]
    da_all, du, dh = np.empty((t, b, 2 * n), u.dtype), np.zeros_like(u), np.zeros((b, n), u.dtype)
    for k in range(t - 1, -1, -1):
        h, z, c, mz, mc = saved[k]
        dh = dh + dout[k]
        da = da_all[k]
        da[:, :n] = dh * (h - c) * mz * np.float32(0.25)
        da[:, n:] = dh * (1 - z) * mc
        du += h.T @ da
        dh = dh * z + da @ u.T
    flat, at = da_all.reshape(-1, 2 * n), rows.T.reshape(-1)
    dw = np.stack([np.bincount(at, flat[:, j], 256) for j in range(2 * n)], 1).astype(u.dtype)
    return {f"W{d}": dw, f"U{d}": du}


def logits(rows: np.ndarray, p: dict) -> np.ndarray:
    """(T, B, L) label scores of every position."""
    t, b = rows.shape[1], rows.shape[0]
    f, _ = _forward(rows, p, "f")
    g, _ = _forward(rows[:, ::-1], p, "b")
    n = f.shape[2]
    return (f.reshape(-1, n) @ p["Of"] + g[::-1].reshape(-1, n) @ p["Ob"] + p["b"]).reshape(t, b, -1)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of every window, its text, its first counted position; WINDOW minus the length, negated, for padded ones)."""
    lens = np.array([len(t) for t in texts], np.int64)
    padded = [t if len(t) >= WINDOW else t.ljust(WINDOW) for t in texts]
    size = np.maximum(lens, WINDOW)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(texts)), count)
    k = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    start = np.minimum(k * WINDOW, size[doc] - WINDOW)
    data = np.frombuffer(b"".join(padded), np.uint8)
    rows = data[(base[doc] + start)[:, None] + np.arange(WINDOW)]
    return rows, doc, np.where(lens[doc] < WINDOW, lens[doc] - WINDOW, k * WINDOW - start)


def probabilities(texts: list[bytes], p: dict) -> np.ndarray:
    """Mean label distribution over all byte positions of each text."""
    n = p["b"].shape[0]
    out, total = np.zeros((len(texts), n)), np.array([max(1, len(t)) for t in texts], float)
    rows, doc, first = windows(texts)
    at = np.arange(WINDOW)[:, None]
    for i in range(0, len(rows), BLOCK):
        f = first[i : i + BLOCK]
        s = logits(rows[i : i + BLOCK], p)
        np.exp(s - s.max(2, keepdims=True), out=s)
        s /= s.sum(2, keepdims=True)
        odd = f != 0
        if odd.any():
            keep = (at >= f[odd]) & ((f[odd] > 0) | (at < WINDOW + f[odd]))
            s[:, odd] *= keep[:, :, None]
        pooled = s.sum(0, dtype=np.float64)
        for j in range(n):
            out[:, j] += np.bincount(doc[i : i + BLOCK], pooled[:, j], len(texts))
    return out / total[:, None]


def loss_and_gradient(b: np.ndarray, label: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean cross-entropy of all positions of windows b with the given labels, and its gradient by backpropagation through time."""
    n = p["Uf"].shape[0]
    f, sf = _forward(b, p, "f", True)
    g, sg = _forward(b[:, ::-1], p, "b", True)
    t, w = b.shape[1], len(b)
    s = f.reshape(-1, n) @ p["Of"] + g[::-1].reshape(-1, n) @ p["Ob"] + p["b"]
    s = np.exp(s - s.max(1, keepdims=True))
    s /= s.sum(1, keepdims=True)
    own = np.arange(t * w), np.tile(label, t)
    loss = -float(np.log(s[own]).mean(dtype=np.float64))
    s[own] -= 1
    s /= t * w
    grad = {"Of": f.reshape(-1, n).T @ s, "Ob": g[::-1].reshape(-1, n).T @ s, "b": s.sum(0)}
    grad |= _backward(b, p, "f", sf, (s @ p["Of"].T).reshape(t, w, n))
    grad |= _backward(b[:, ::-1], p, "b", sg, (s @ p["Ob"].T).reshape(t, w, n)[::-1])
    return loss, grad


def fit(rows: list[tuple[str, str]], seed: int = 7) -> dict | None:
    """Parameters and label names from (text, language) rows; None without any."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(names)
    p = {f"W{d}": rng.normal(0, 0.3, (256, 2 * n)).astype(np.float32) for d in "fb"}
    p |= {f"U{d}": rng.normal(0, 0.3, (n, 2 * n)).astype(np.float32) for d in "fb"}
    p |= {f"O{d}": rng.normal(0, 0.3, (n, k)).astype(np.float32) for d in "fb"} | {"b": np.zeros(k, np.float32)}
    xs, ys = [], []
    for i, lang in enumerate(names):
        texts = [t.encode("utf-8", "surrogatepass") for t, x in rows if x == lang and t.strip()]
        if not texts:
            continue
        w, _, _ = windows(texts)
        xs.append(w[rng.integers(0, len(w), TRAIN_WINDOWS)])
        ys.append(np.full(TRAIN_WINDOWS, i))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    total = EPOCHS * -(-len(x) // BATCH)
    m, v, step = {q: np.zeros_like(a) for q, a in p.items()}, {q: np.zeros_like(a) for q, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            _, grad = loss_and_gradient(x[at], y[at], p)
            step += 1
            rate = np.float32(0.025 * (1 - step / total) + 0.0005)
            for q, a in p.items():  # Adam
                m[q] += np.float32(0.1) * (grad[q] - m[q])
                v[q] += np.float32(0.01) * (grad[q] ** 2 - v[q])
                a -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + np.float32(1e-8))
    return {"names": names, "p": {q: a.astype(np.float32) for q, a in p.items()}}


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held_out: int = 1) -> list[tuple[str, str]]:
    """(text, language) of about MAX_DOCS labelled documents per language, chosen by hash, outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).withColumn("f", fold("k", folds)).filter(f"l IS NOT NULL AND t IS NOT NULL AND f <> {held_out}")
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b"))  # one row per language
    place, share = F.pmod(F.xxhash64(F.lit(29), "k"), F.lit(2**30)), f"least(1D, {MAX_DOCS}D / n, {MAX_BYTES}D / greatest(b, 1))"
    some = rows.join(F.broadcast(sizes), "l").filter(place < F.expr(f"CAST({share} * {2**30} AS BIGINT)")).select("k", "t", "l").collect()  # about MAX_DOCS rows and MAX_BYTES bytes per language
    return [(r.t, r.l) for r in sorted(some, key=lambda r: (r.k, r.t, r.l))]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held_out: int = 1) -> dict | None:
    return fit(sample(docs, key, text, lang, folds, held_out))


def _pairs(text: str) -> np.ndarray:
    """Codes of the neighbouring bytes of a text; none for one shorter than a window."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    return x[:-1] * 256 + x[1:] if len(x) >= WINDOW else x[:0]


def known_pairs(rows: list[tuple[str, str]]) -> tuple[np.ndarray, float]:
    """(which byte pairs occur in the rows' texts, the share of others above which a text is in no learned language).

    The share is twice the highest that a row's text has against all the others, so that texts like them stay, and LEAST_STRANGE at
    least. Without texts of a window it is 1, which rejects nothing.
    """
    codes = [c for c in (_pairs(t) for t, _ in rows) if len(c)]
    texts = np.zeros(1 << 16, np.int32)
    for c in codes:
        texts[np.unique(c)] += 1
    return texts > 0, max(LEAST_STRANGE, 2 * max(float((texts[c] == 1).mean()) for c in codes)) if codes else 1.0


def strangeness(known: np.ndarray, text: str = "text") -> Column:
    """Share of a text's byte pairs that are not known; 0 for null and for texts shorter than a window, which tell too little."""

    def run(texts: pd.Series) -> pd.Series:
        codes = (_pairs(t or "") for t in texts)
        return pd.Series([1 - float(known[c].mean()) if len(c) else 0.0 for c in codes], dtype=float)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(F.col(text))


def predictor(model: dict | None, text: str = "text") -> Column:
    """struct<lang_pred, score> of a text column; only that column goes through Python."""

    def run(texts: pd.Series) -> pd.DataFrame:
        names, score = [UND] * len(texts), np.zeros(len(texts))
        if model:
            some = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            size, run_of = 0, []
            for n, i in enumerate(some):
                run_of.append(i)
                size += len(texts[i])
                if size > 1 << 20 or n == len(some) - 1:
                    probs = probabilities([texts[j].encode("utf-8", "surrogatepass") for j in run_of], model["p"])
                    best = probs.argmax(1)
                    for j, b, q in zip(run_of, best, probs, strict=True):
                        names[j], score[j] = model["names"][b], min(1.0, q[b])
                    size, run_of = 0, []
        tidy()
        return pd.DataFrame({"lang_pred": names, "score": score})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double")(F.col(text))


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score per row."""
    model = train(docs, key, text, lang)
    out = docs.select(F.col(key).alias(key), F.coalesce(fold(key, 3) == 1, F.lit(False)).alias("held_out"), predictor(model, text).alias("p"))
    return out.select(key, "held_out", "p.lang_pred", "p.score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(read(spark, sf_dir, "documents"))
