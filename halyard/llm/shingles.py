"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of many documents at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A document's set holds the distinct hashes of its
k-word windows; a shorter document has its whole word sequence as one shingle; without words the set is empty.
"""

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about CHUNK_BYTES; a null counts as empty."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(b) > CHUNK_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each document)."""
    lens = np.array([len(d) + 1 for d in docs], np.int64)
    data = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    start_at = np.flatnonzero(inside & ~before)
    ends = np.cumsum(lens)
    per_doc = np.diff(np.searchsorted(start_at, ends), prepend=0)
    if not len(start_at):
        return np.zeros(0, U), per_doc
    chars = _LOWER[data[inside]]
    word_of = np.cumsum((inside & ~before)[inside]) - 1
    first = np.flatnonzero(np.diff(word_of, prepend=-1))
    pos = np.arange(len(chars)) - first[word_of]
    longest = int(pos.max()) + 1
    power = np.full(longest, _STEP, U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(_BYTE[chars] * power[pos], first)
    return mix(h ^ (np.diff(first, append=len(chars)).astype(U) * U(0xD6E8FEB86659FD93))), per_doc


def shingle_sets(docs: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents in order, size of each document's set)."""
    words, n = word_hashes(docs)
    factor = mix(np.arange(1, k + 1, dtype=U) * _STEP) | U(1)
    at = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= k:
        full = sum((words[i : len(words) - k + 1 + i] * factor[i] for i in range(k)), np.zeros(len(words) - k + 1, U))
        full = mix(full)
    else:
        full = np.zeros(0, U)
    parts, sizes = [], np.zeros(len(docs), np.int64)
    for i in range(len(docs)):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            s = np.unique(full[lo : hi - k + 1])
        elif hi > lo:
            s = mix(np.add.reduce(words[lo:hi] * factor[: hi - lo], keepdims=True) ^ U(hi - lo))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), sizes
