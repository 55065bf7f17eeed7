"""Repetition inside a single document: the share of its words that repeat an earlier part of it.

``repeated_words`` measures the share. ``self_repeating`` finds the documents that largely repeat themselves with a
hashed n-gram logistic regression (``hashed``), trained on a bounded sample labelled by the measure and calibrated;
it scores all documents in Arrow batches against fixed thresholds, and what it holds possible is measured.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigraph.llm.hashed import HashedModel, fit, varied
from trigraph.llm.text import words_of

#: Words of the sequences looked up, and least words of a passage that counts as repeated.
SEED, LEAST = 3, 7
#: Changed words that may stand between two repeated stretches of one passage.
CHANGED = 1
#: Share of repeated words from which a document largely repeats itself.
SHARE = 0.3
#: Probability from which a document may repeat itself and is measured, and from which it likely does.
POSSIBLE, LIKELY = 0.02, 0.5
#: Documents of the training sample, their greatest length in characters, and invented texts beside them.
SAMPLE, SAMPLE_LENGTH, INVENTED = 500, 100_000, 100

MEASURED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("repeated_words", T.LongType()),
        T.StructField("repeated_share", T.DoubleType()),
    ]
)


def normal_words(text: str | None) -> list[str]:
    """Words without case, punctuation and markup; all numbers alike."""
    return ["0" if w.isdigit() else w for w in words_of(text)]


def repeated_words(words: list[str], seed: int = SEED, least: int = LEAST, changed: int = CHANGED) -> int:
    """Number of words in passages that stood earlier.

    From left to right the longest earlier stretch that goes on here is followed, stepping over at most ``changed``
    unlike words on either side if ``seed`` like words come after them. A passage of ``least`` or more words counts
    with the changed words in it. All earlier places of a sequence are tried, up to one from which the rest of the text
    is followed; so a long text that opens very many unlike sentences alike takes time as the square of their number.
    """
    n = len(words)
    if n < least + 1:
        return 0
    grams: list[tuple[str, ...]] = [tuple(words[i : i + seed]) for i in range(n - seed + 1)]
    places: dict[tuple[str, ...], list[int]] = {}
    steps = _steps(changed)
    total = i = 0
    noted = 0
    while i < len(grams):
        while noted < i:
            places.setdefault(grams[noted], []).append(noted)
            noted += 1
        best = 0
        for j in places.get(grams[i], ()):
            a, b, end = j + seed, i + seed, i + seed
            while b < n:
                if words[a] == words[b]:
                    a, b = a + 1, b + 1
                    end = b
                    continue
                for x, y in steps:
                    if b + y + seed <= n and a + x + seed <= b + y and words[a + x : a + x + seed] == words[b + y : b + y + seed]:
                        a, b = a + x, b + y
                        break
                else:
                    break
            best = max(best, end - i)
            if end == n:
                break
        if best >= least:
            total += best
            i += best
        else:
            i += 1
    return total


def _steps(most: int) -> list[tuple[int, int]]:
    return sorted(((x, y) for x in range(most + 1) for y in range(most + 1) if x or y), key=lambda s: (-min(s), sum(s)))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, repeated_words, repeated_share) per document, in one pass without a shuffle of texts.

    Defined cases: null ids give no rows; null, empty and wordless texts have share 0. A repeated row gives its
    measure once; of several texts under one id the greatest share counts. Texts are read whole, whatever their
    length. Other columns are never read.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, body in zip(batch["__i"], batch["__t"]):
                words = normal_words(body)
                repeated = repeated_words(words)
                rows.append((ident, len(words), repeated, repeated / len(words) if words else 0.0))
            yield pd.DataFrame(rows, columns=MEASURED.names)

    base = docs.select(F.col(doc_id).cast("bigint").alias("__i"), F.col(text).cast("string").alias("__t")).where("__i is not null")
    best = base.mapInPandas(score, MEASURED).groupBy("doc_id").agg(F.max(F.struct("repeated_share", "n_words", "repeated_words")).alias("b"))
    return best.select(F.col("doc_id").alias(doc_id), "b.n_words", "b.repeated_words", "b.repeated_share")


def repeats(words: Sequence[str], share: float = SHARE) -> bool:
    return bool(words) and repeated_words(list(words)) >= share * len(words)


def _invented(n: int) -> list[list[str]]:
    """Texts of made-up words, common and rare, so that there is something to learn from in the smallest table."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    often = [1 / (k + 10) for k in range(len(pool))]
    return [rng.choices(pool, often, k=rng.randint(10, 400)) for _ in range(n)]


def trained(docs: DataFrame, text: str = "text", share: float = SHARE, sample: int = SAMPLE) -> HashedModel:
    """The classifier, fitted on the driver to at most ``sample`` texts of at most ``SAMPLE_LENGTH`` characters.

    The texts are the first that are read, so no second pass over the documents is needed. What tells repetition is
    the same in all texts, and each is also taken with passages said again (``varied``), so which texts are
    in the sample matters little. Labels come from ``repeats``.
    """
    base = docs.select(F.col(text).cast("string").alias("t")).where(F.length("t").between(1, SAMPLE_LENGTH))
    texts = [normal_words(r.t) for r in base.limit(sample).collect()]
    return fit(*varied(texts + _invented(INVENTED), lambda words: repeats(words, share)))


def _scan(docs: DataFrame, doc_id: str, text: str, model: HashedModel, least: float, share: float | None) -> DataFrame:
    """(doc_id, probability) of documents with ``least`` probability, and with ``share`` measured if one is given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            texts = [normal_words(t) for t in batch["__t"]]
            found = [(i, float(p)) for i, p, w in zip(batch["__i"], known.probabilities(texts), texts) if p >= least and (share is None or repeats(w, share))]
            yield pd.DataFrame(found, columns=["doc_id", "probability"])

    base = docs.select(F.col(doc_id).cast("bigint").alias("__i"), F.col(text).cast("string").alias("__t")).where("__i is not null")
    return base.mapInPandas(score, "doc_id long, probability double")


def self_repeating(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, model: HashedModel | None = None) -> DataFrame:
    """Ids of the documents of which at least ``share`` of the words repeat an earlier part.

    The classifier scores every document; those of a probability of ``POSSIBLE`` or more are measured exactly.

    Defined cases as in ``measure``; an id is given once if one of its texts repeats itself.
    """
    model = model or trained(docs, text, share)
    return _scan(docs, doc_id, text, model, POSSIBLE, share).select(F.col("doc_id").alias(doc_id)).distinct()


def repetition_grades(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: HashedModel | None = None) -> DataFrame:
    """(doc_id, probability, grade) per document by the classifier alone: grade is likely, possible or no by the fixed
    thresholds ``LIKELY`` and ``POSSIBLE``. Defined cases as in ``measure``; of several texts the greatest probability counts."""
    scored = _scan(docs, doc_id, text, model or trained(docs, text), 0.0, None)
    best = scored.groupBy("doc_id").agg(F.max("probability").alias("probability"))
    grade = F.when(F.col("probability") >= LIKELY, "likely").when(F.col("probability") >= POSSIBLE, "possible").otherwise("no")
    return best.select(F.col("doc_id").alias(doc_id), "probability", grade.alias("grade"))
