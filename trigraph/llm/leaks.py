"""Evaluation items that leak into training text.

One Aho-Corasick automaton holds the word phrases of all normalised items. Each text is scanned once; the places of
the hits map back to the original text through the words' offsets. Texts with hits are then verified exactly: around
the hits the item is aligned with the text, word by word and in order, and the item's words reproduced in passages
are counted. What can't reach the least share, by the number of words around its hits, isn't aligned.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigraph.functions.lineage import cut
from trigraph.llm.text import words_of, words_with_places
from trigraph.llm.variants import one_slip

#: Words of a phrase in the automaton. Shorter ones survive more alterations, longer ones meet less common speech.
PHRASE = 3
#: Words with which more items than this open are stock if the items go on differently; they don't count.
STOCK_ITEMS = 3
#: Least words of a stock opening, and greatest mean similarity of what follows it in the items that share it.
OPENING, ALIKE = 5, 0.35
#: Hashes from which that similarity is estimated.
SIGNS = 16
#: Least share of an item's words, and least words of a passage.
SHARE, PASSAGE = 0.4, 6
#: Unlike words that may stand between like ones of a passage, on either side.
GAP = 3
#: Item words that one automaton (one broadcast) may hold; more items are scanned in further blocks.
BLOCK_WORDS = 250_000

FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_PRIME = (1 << 61) - 1
_FACTORS = [pow(0x9E3779B97F4A7C15, j + 1, _PRIME) for j in range(SIGNS)]


class Items:
    """Normalised items (id, words, length of the stock opening) and the automaton over their phrases."""

    def __init__(self, items: Sequence[tuple[int, Sequence[str], int]], share: float = SHARE, phrase: int = PHRASE):
        import ahocorasick

        self.phrase, self.share = phrase, share
        self.ids = [i for i, _, _ in items]
        self.words = [list(w) for _, w, _ in items]
        self.opening = [o for _, _, o in items]
        self.need = [share * self.whole(k) for k in range(len(items))]
        self.least = min(self.need, default=0.0)
        self.at: list[list[tuple[int, int]]] = []
        numbers: dict[str, int] = {}
        for item, w in enumerate(self.words):
            n = min(phrase, len(w) - self.opening[item])
            for k in range(self.opening[item], len(w) - n + 1):
                if n:
                    p = numbers.setdefault(f" {' '.join(w[k : k + n])} ", len(numbers))
                    if p == len(self.at):
                        self.at.append([])
                    self.at[p].append((item, k))
        self.automaton = ahocorasick.Automaton()
        for p, number in numbers.items():
            self.automaton.add_word(p, (number, len(p)))
        if numbers:
            self.automaton.make_automaton()

    def whole(self, item: int) -> float:
        """The words of which a share is asked. Few own words behind a long stock opening are asked for entirely."""
        return min(len(self.words[item]), (len(self.words[item]) - self.opening[item]) / self.share)

    def hits(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item -> (word of the text, word of the item) of each phrase hit.

        Nothing if even all hits together have too few words around them for any item.
        """
        if not self.at or not words:
            return {}
        text = f" {' '.join(words)} "
        raw = list(self.automaton.iter(text))
        if not raw:
            return {}
        begins, at = [], 0
        for w in words:
            begins.append(at)
            at += len(w) + 1
        found = [(bisect_left(begins, end - size + 1), number) for end, (number, size) in raw]
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if sum(hi - lo for lo, hi in self._spans([at for at, _ in found], len(words))) >= self.least:
            for at, number in found:
                for item, k in self.at[number]:
                    out[item].append((at, k))
        return out

    def _spans(self, places: Sequence[int], n: int, gap: int = GAP) -> list[tuple[int, int]]:
        """Word ranges around hits in which passages can lie."""
        reach = 2 * gap + self.phrase
        spans: list[list[int]] = []
        for at in places:
            if spans and at - reach <= spans[-1][1]:
                spans[-1][1] = at + reach + self.phrase
            else:
                spans.append([max(0, at - reach), at + reach + self.phrase])
        return [(lo, min(hi, n)) for lo, hi in spans]

    def passages(self, item: int, words: list[str], hits: list[tuple[int, int]], passage: int = PASSAGE, gap: int = GAP) -> tuple[float, list[tuple[int, int]]]:
        """Share of the item's words that passages of the text reproduce in order, and the passages as word ranges."""
        want, opening = self.words[item], self.opening[item]
        own = len(want) - opening
        spans = self._spans([at for at, _ in hits], len(words), gap)
        if sum(hi - lo for lo, hi in spans) < self.need[item]:
            return 0.0, []
        # No more words are covered than stand around the hits, equal or mistyped; mistyped ones follow equal ones.
        near = {w for lo, hi in spans for w in words[lo:hi]}
        equal = sum(w in near for w in want[opening:])
        if equal < self.need[item]:
            if equal * (1 + gap) < self.need[item]:
                return 0.0, []
            rests = frozenset().union(*map(_rests, near))
            if equal + sum(w not in near and not rests.isdisjoint(_rests(w)) for w in want[opening:]) < self.need[item]:
                return 0.0, []
        found: list[tuple[int, int, list[int]]] = []
        matcher = SequenceMatcher(None, "", want, autojunk=False)
        # Long stretches of hits are aligned in overlapping pieces, each long enough for the whole item.
        step = len(want) * (1 + gap)
        for lo, hi in ((k, min(k + 2 * step, hi)) for lo, hi in spans for k in range(lo, max(lo + 1, hi - step), step)):
            part = words[lo:hi]
            matcher.set_seq1(part)
            run: list[tuple[int, int]] = []  # equal words, and mistyped ones between them
            for a, b, n in [*matcher.get_matching_blocks()[:-1], (1 << 60, 1 << 60, 0)]:
                if run and (a - run[-1][0] > gap + 1 or b - run[-1][1] > gap + 1):
                    got = [y for _, y in run if y >= opening]
                    if len(got) >= min(passage, own):
                        found.append((lo + run[0][0], lo + run[-1][0], got))
                    run = []
                while run and (x := run[-1][0] + 1) < a < 1 << 60 and (y := run[-1][1] + 1) < b and one_slip(part[x], want[y]):
                    run.append((x, y))
                run.extend((a + k, b + k) for k in range(n))
        covered = {y for _, _, got in found for y in got}
        return len(covered) / max(1.0, self.whole(item)), [(a, b) for a, b, _ in found]


@lru_cache(1 << 16)
def _rests(word: str) -> frozenset[str]:
    """The word and what is left of it without one letter; words a slip apart share one."""
    return frozenset([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))])


def _number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big") % _PRIME


def _openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(words, size, prefix, signs) of every way to cut an item in an opening and a rest: least hashes of the rest's words."""
    for batch in batches:
        rows = []
        for words in batch["words"]:
            w = [_number(x) for x in words]
            prefixes = [0]
            for x in w:
                prefixes.append((prefixes[-1] * 1_000_003 + x + 1) % _PRIME)
            least, signs = [_PRIME] * SIGNS, {}
            for k in range(len(w) - PHRASE, OPENING - 1, -1):
                for x in w[k:] if k == len(w) - PHRASE else w[k : k + 1]:
                    least = [min(m, (x + 1) * _FACTORS[j] % _PRIME) for j, m in enumerate(least)]
                signs[k] = least
            rows.extend((words, k, prefixes[k], s) for k, s in signs.items())
        yield pd.DataFrame(rows, columns=["words", "size", "prefix", "signs"])


def prepared_items(items: DataFrame, item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(item_id, words, opening) of each item: its normalised words, and how many of them are a stock opening.

    An opening is stock if more than ``STOCK_ITEMS`` different items share it and go on differently, so that items
    unlike in a word or two don't make their common text stock. How similar (Jaccard, mean of all pairs) the words are
    that follow is estimated from their least hashes, which are only counted. At least a phrase is left behind it.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["i"], "words": [words_of(t) for t in batch["t"]]})

    texts = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    held = texts.mapInPandas(split, "item_id long, words array<string>").distinct()
    ways = cut(held.select("words").distinct().mapInPandas(_openings, "words array<string>, size int, prefix long, signs array<long>"))
    shared = ways.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STOCK_ITEMS)
    signs = ways.join(shared, "prefix").select("prefix", "n", F.posexplode("signs").alias("j", "sign"))
    equal = signs.groupBy("prefix", "n", "j", "sign").agg(F.count(F.lit(1)).alias("c")).groupBy("prefix", "n").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("equal"))
    stock = equal.where(F.col("equal") <= ALIKE * SIGNS * F.col("n") * (F.col("n") - 1))
    opening = ways.join(stock, "prefix", "left_semi").groupBy("words").agg(F.max("size").alias("opening"))
    return held.join(opening, "words", "left").select("item_id", "words", F.coalesce("opening", F.lit(0)).alias("opening"))


_held: dict[str, Items] = {}


def _shared_items(key: str, rows: Sequence[tuple[int, Sequence[str], int]], share: float) -> Items:
    """The automaton of a block, built once in a worker process."""
    if key not in _held:
        _held.clear()
        _held[key] = Items(rows, share)
    return _held[key]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, share, passages) of each text that reproduces at least ``share`` of an item's words in order.

    ``passages`` are character ranges of the original text. A passage has at least ``PASSAGE`` like words, with at
    most ``GAP`` unlike ones between two of them; words of a stock opening (``prepared_items``) don't count as
    reproduced. If an item's own words are less than ``share`` of it, all of them are asked for.

    Items are prepared by the executors, spread by a hash over blocks of about ``block_words`` words, and go to the executors
    block by block, each scanned over all texts, so neither driver nor broadcast holds more than a block.

    Defined cases: null texts, items, or ids give no rows; empty texts have no words. Items of fewer words than a
    phrase are matched as a whole. Repeated documents give one row; equal items under two ids are both reported, and
    two texts under one id are two items of which the greater share counts. Texts may be of any length: alignment is
    confined to the surroundings of hits. Other columns are never read.
    """
    spark = docs.sparkSession
    held = cut(prepared_items(items, item_id, item_text))
    blocks = -(-(held.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)
    mine = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, blocks)))
    base = docs.select(F.col(doc_id).cast("bigint").alias("__i"), F.col(text).cast("string").alias("__t")).where("__i is not null and __t is not null")
    out = None
    for block in range(blocks):
        rows = [(r.item_id, list(r.words), r.opening) for r in held.where(mine == block).collect()]
        if not rows:
            continue
        shared, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            known = _shared_items(key, shared.value, share)
            for batch in batches:
                found = []
                for ident, body in zip(batch["__i"], batch["__t"]):
                    words, starts, ends = words_with_places(body)
                    for item, hits in known.hits(words).items():
                        got, spans = known.passages(item, words, hits)
                        if got >= share:
                            found.append((ident, known.ids[item], got, [{"start": starts[a], "end": ends[b]} for a, b in spans]))
                yield pd.DataFrame(found, columns=FOUND.names)

        part = base.mapInPandas(scan, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "passages")).alias("b"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "b.share", "b.passages")
