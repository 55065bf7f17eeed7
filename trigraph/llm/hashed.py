"""A hashed n-gram classifier of repetitive documents: features, training, calibration, scoring.

Word and character n-grams are hashed. The first time a document has a gram it counts in a bucket by its hash; when it
comes again it counts in the bucket of its kind for grams that come again, because whether words stood before in
the same document doesn't show in which words they are. A logistic regression over the buckets' shares is fitted
by Newton's method and its scores are calibrated to probabilities on rows left out of the fit.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: Kinds of grams: of so many words, of so many characters.
WORD_GRAMS, CHAR_GRAMS = (1, 3, 5), (8,)
KINDS = len(WORD_GRAMS) + len(CHAR_GRAMS)
#: Buckets of grams that are new in their document.
BUCKETS = 256
SIZE = BUCKETS + KINDS + 1
#: Documents scored at once.
PIECE = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _grams(codes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` codes within a document, and their documents."""
    m = len(codes) - n + 1
    if m <= 0:
        return codes[:0], docs[:0]
    h = codes[:m].copy()
    for k in range(1, n):
        h = (h * _STEP) ^ codes[k : k + m]
    same = docs[:m] == docs[n - 1 :]
    return h[same] * _MIX, docs[:m][same]


def _again(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a gram stood before in its document. Sorted as one number each: hash above, place below."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        bits = np.uint64(len(hashes).bit_length())
        keys = ((hashes ^ (docs.astype(np.uint64) + np.uint64(1)) * _STEP) * _MIX) >> bits << bits
        keys |= np.arange(len(hashes), dtype=np.uint64)
        keys.sort()
        same = keys[1:] >> bits == keys[:-1] >> bits
        out[(keys[1:][same] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return out


def entries(texts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of documents given as word lists; repeated entries add up."""
    seen: dict[str, int] = {}
    codes = np.array([seen.get(w) or seen.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) or 1) for words in texts for w in words], dtype=np.uint64) * _MIX
    docs = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    joined = [" ".join(w) for w in texts]
    letters = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) * _MIX
    at = np.repeat(np.arange(len(texts)), [len(j) for j in joined])
    kinds = [(codes, docs, n) for n in WORD_GRAMS] + [(letters, at, n) for n in CHAR_GRAMS]
    rows = [np.arange(len(texts))]
    buckets = [np.full(len(texts), SIZE - 1)]
    values = [np.ones(len(texts))]
    for k, (c, d, n) in enumerate(kinds):
        h, of = _grams(c, d, n)
        b = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        b[_again(h, of)] = BUCKETS + k
        rows.append(of)
        buckets.append(b)
        values.append(1.0 / np.bincount(of, minlength=len(texts))[of])
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class HashedModel:
    """Weights of the buckets, and the line that calibrates scores."""

    weights: np.ndarray
    slope: float
    shift: float

    def probabilities(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        score = np.zeros(len(texts))
        for at in range(0, len(texts), PIECE):
            part = texts[at : at + PIECE]
            row, bucket, value = entries(part)
            score[at : at + len(part)] = np.bincount(row, weights=self.weights[bucket] * value, minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def fit(texts: Sequence[Sequence[str]], labels: Sequence[bool], ridge: float = 0.05) -> HashedModel:
    """The model of labelled documents (word lists). Every third row is left out of the fit and calibrates it."""
    row, bucket, value = entries(texts)
    x = np.bincount(row * SIZE + bucket, weights=value, minlength=len(texts) * SIZE).reshape(len(texts), SIZE)
    y = np.asarray(labels, dtype=float)
    held = np.arange(len(texts)) % 3 == 2
    w = _newton(x[~held], y[~held], ridge)
    scores = np.stack([x[held] @ w, np.ones(held.sum())], axis=1)
    line = _newton(scores, y[held], 1e-3)
    return HashedModel(w, float(line[0]), float(line[1]))


def varied(texts: Sequence[Sequence[str]], label: Callable[[Sequence[str]], bool], seed: int = 5) -> tuple[list[list[str]], list[bool]]:
    """Labelled rows from ``texts``: each as it is, and three times with a passage of its own said again.

    The passage is from a phrase to the whole text, said again one to six times, whole or with an odd word changed,
    so that all shares occur, those about the border of the label too, whatever texts there are.
    """
    rng = random.Random(seed)
    rows: list[list[str]] = []
    for words in texts:
        rows.append(list(words))
        for _ in range(3):
            if len(words) < 8:
                continue
            size = rng.randint(7, max(7, len(words) // rng.randint(1, 5)))
            at = rng.randint(0, len(words) - size)
            out = list(words)
            for _ in range(rng.choice((1, 1, 1, 2, 3, 6))):
                copy = list(words[at : at + size])
                if rng.random() < 0.6:
                    for k in range(rng.randint(3, 9), size, rng.randint(5, 12)):
                        copy[k] = rng.choice(words) + "x"
                place = rng.choice((len(out), len(out), rng.randint(0, len(out))))
                out[place:place] = copy
            rows.append(out)
    rng.shuffle(rows)
    return rows, [label(r) for r in rows]
