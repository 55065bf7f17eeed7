"""Variant spellings of names typed by people.

Spellings are first folded (case, accents, punctuation, titles, inversion at a comma), which joins exact copies. What remains
is linked in two steps:

1. A prefix-filtered set-similarity join on token q-grams finds the tokens one typing slip apart. Grams are put in
   order from rare to common; tokens that share enough grams must share one among their few rarest, at about the same
   place, so only these are joined.
2. Names meet on a part (or one a slip apart) together with a second part that is alike in both: equal, a slip apart,
   abbreviated, a nickname, an initial or the initials of words. No part is too frequent or too short to meet on; a
   frequent surname doesn't bring all its names together, since the second part must be alike too. Each pair is verified by a soft weighted
   token similarity: parts are aligned as equal, mistyped, abbreviated, initial or nickname, and count by their
   rarity. The search misses no pair that the similarity accepts.

Linked spellings form classes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigraph.functions.lineage import cut, stored_rows
from trigraph.functions.skew import components, lookup
from trigraph.operators.packed import packed_values

#: Names that name nobody.
NOBODY = ("anonymous", "various")
#: Titles, suffixes, roles and joining words: no part of a name.
EMPTY_WORDS = frozenset("dr prof professor mr mrs ms miss sir dame rev phd md dds esq jr sr ii iii iv ed eds editor trans translator illus the and of".split())
#: Usual short forms of first names, the default of a parameter. Those that a spelling itself gives in quotation marks are added to them.
NICKNAMES = {
    "abigail": "abbie abby gail", "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony", "beatriz": "bea",
    "benjamin": "ben", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny",
    "david": "dave", "dorothy": "dolly dot dottie", "edward": "ed eddie ned ted teddy", "elias": "eli",
    "elizabeth": "beth betsy betty eliza libby liz lizzie", "frederick": "fred freddie freddy", "gabriella": "ella gabby gaby",
    "george": "georgie", "gregory": "greg", "harold": "hal harry", "henry": "hank harry", "isabel": "bella belle izzy",
    "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe", "josephine": "jo josie",
    "katherine": "kate kathy katie kitty", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny leo",
    "margaret": "maggie madge meg peg peggy", "matthew": "matt", "michael": "mick mickey mike", "nathaniel": "nat",
    "nicholas": "nick nicky nico", "oswald": "oz ozzie", "patricia": "pat patty tricia trish", "peter": "pete", "philippa": "pip pippa",
    "rebecca": "becca becky", "richard": "dick rick", "robert": "bob bobby rob robbie", "samuel": "sam", "stephen": "steve",
    "susannah": "sue susie suzy", "svetlana": "lana sveta", "theodora": "dora thea", "theodore": "ted theo", "thomas": "tom tommy",
    "timothy": "tim", "ulrich": "uli", "victoria": "tori vicki vicky", "vincent": "vince vinny", "william": "bill billy will", "zachary": "zach zack",
}
#: Length of grams, and the most grams one slip (letter added, lost, changed, or two swapped) can change.
GRAM, CHANGED = 4, 5
#: Shortest token whose slips are searched by grams; slips among those up to this length are found by leaving out a letter.
SEARCHED = 5
#: Size of the table of gram counts that all tasks share.
GRAM_SLOTS = 1 << 16
#: Parts of at most so many letters may leave out letters inside a word; longer ones abbreviate it only as its beginning.
BRIEF = 5
#: Least soft similarity of linked names, and what the kinds of likeness are worth.
THRESHOLD = 0.85
EQUAL, SLIP, NICK, INITIAL, SHORT = 1.0, 0.95, 0.95, 0.95, 0.95
#: Part of all names' parts from which on a token is hot; so there are fewer than 1 / HOT.
HOT = 1e-3
#: Most letters of a hot token with its first names and likes, as hot tokens are sent to all; with more it is joined as others are.
HOT_LETTERS = 10_000

_quoted = re.compile(r"[\"“«‘'](\w{2,})[\"”»’']")
_first_quoted = re.compile(r"(\w+)\s+[\"“«‘'](\w{2,})[\"”»’']")
_token = re.compile(r"[^\W_]+")
_letters = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})

FOLDED = T.StructType([T.StructField("name", T.StringType()), T.StructField("folded", T.StringType()), T.StructField("nick", T.StringType()), T.StructField("first", T.StringType())])


def fold(text: str) -> str:
    text = text.lower().translate(_letters)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def folded_name(name: str) -> str:
    """The name's parts, folded, given names first, without titles and without a nickname in quotation marks."""
    text = fold(name)
    plain = _quoted.sub(" ", text)
    before, _, after = (plain if _token.search(plain) else text).partition(",")
    parts = [[t for t in _token.findall(p) if t not in EMPTY_WORDS] for p in (after, before)]
    return " ".join(parts[0] + parts[1])


def _fold_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name in batch["name"]:
            m = _first_quoted.search(fold(name))
            rows.append((name, folded_name(name), m[2] if m else None, m[1] if m else None))
        yield pd.DataFrame(rows, columns=FOLDED.names)


def one_slip(a: str, b: str) -> bool:
    """One letter added, lost or changed, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


def _grams(token: str) -> list[str]:
    padded = f"^^{token}$$"
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def mistyped(a: str, b: str) -> bool:
    """One slip apart and long enough for that to tell something: four letters with three."""
    return min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and one_slip(a, b)


def shortened(a: str, b: str) -> bool:
    """Whether ``a`` is ``b`` cut off, or, if brief, ``b`` with letters left out."""
    if a[0] != b[0] or len(a) >= len(b):
        return False
    rest = iter(b)
    return b.startswith(a) or len(a) <= BRIEF and all(c in rest for c in a)


def _short_slips(tokens: DataFrame) -> DataFrame:
    """(token, other) as ``token_slips``, of tokens up to ``SEARCHED`` letters: such share what is left without one letter."""

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, k) for t in batch["token"] for k in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}], columns=["token", "rest"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[mistyped(a, b) for a, b in zip(batch["token"], batch["other"])]]

    rests = cut(tokens.where(F.length("token").between(3, SEARCHED)).mapInPandas(left, "token string, rest string"))
    near = rests.join(rests.withColumnRenamed("token", "other"), "rest").where("token <> other").select("token", "other").distinct()
    return near.mapInPandas(verify, "token string, other string")


def token_slips(tokens: DataFrame) -> DataFrame:
    """(token, other) for all ordered pairs of different tokens one slip apart, four letters with three or longer, from distinct (token)."""
    spark = tokens.sparkSession
    long = tokens.where(F.length("token") >= SEARCHED)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"gram": [g for t in batch["token"] for g in _grams(t)]})

    slot = lambda g: F.pmod(F.xxhash64(g), F.lit(GRAM_SLOTS))
    counted = long.mapInPandas(grams, "gram string").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # One number per slot: at most GRAM_SLOTS rows reach the driver, however many tokens there are.
    rarity = {r.slot: r.n for r in counted.groupBy(slot("gram").alias("slot")).agg(F.sum("n").alias("n")).collect()}
    order = spark.sparkContext.broadcast(rarity)
    split = long.select("token", F.expr(f"transform(sequence(1, length(token) + 5 - {GRAM}), i -> substring(concat('^^', token, '$$'), i, {GRAM}))").alias("grams"))
    split = split.select("token", "grams", F.transform("grams", lambda g: slot(g)).alias("slots"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = order.value
        for batch in batches:
            rows = []
            for token, gs, slots in zip(batch["token"], batch["grams"], batch["slots"]):
                ranked = sorted((seen.get(s, 0), g, i) for i, (g, s) in enumerate(zip(gs, slots)))
                rows.extend((token, g, i) for _, g, i in ranked[: CHANGED + 1])
            yield pd.DataFrame(rows, columns=["token", "gram", "at"])

    prefix = cut(split.mapInPandas(prefixes, "token string, gram string, at int"))
    # The shorter token's grams stand in the longer one at the same place or one later; in one of its length, at the same.
    size, at = F.length("token"), F.col("at")
    places = F.array(F.struct(size.alias("size"), at.alias("at")), F.struct((size + 1).alias("size"), at.alias("at")), F.struct((size + 1).alias("size"), (at + 1).alias("at")))
    left = prefix.select("token", "gram", F.explode(places).alias("x")).select("token", "gram", "x.*")
    right = prefix.select(F.col("token").alias("other"), "gram", F.length("token").alias("size"), "at")
    near = left.join(right, ["gram", "size", "at"]).where((F.length("token") < F.length("other")) | (F.col("token") < F.col("other")))
    near = near.where(F.levenshtein("token", "other", 2) >= 0).select("token", "other").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[one_slip(a, b) for a, b in zip(batch["token"], batch["other"])]]

    half = cut(near.mapInPandas(verify, "token string, other string"))
    both = half.unionByName(half.select(F.col("other").alias("token"), F.col("token").alias("other")))
    return cut(both.unionByName(_short_slips(tokens)).distinct())


def _heads(token: str) -> set[str]:
    """The first up to three letters of everything that leaves out letters of ``token`` behind its first."""
    out, seen = set(), set()
    pairs: set[str] = set()
    for c in token[1:]:
        out.update(token[0] + b + c for b in seen if b + c not in pairs)
        pairs.update(b + c for b in seen)
        seen.add(c)
    return out | {token[0] + c for c in seen}


def token_shorts(tokens: DataFrame) -> DataFrame:
    """(token, other) for all tokens of two or more letters that shorten another one, from distinct (token)."""
    many = [r.n for r in tokens.select(F.length("token").alias("n")).where(F.col("n") > BRIEF).distinct().collect()]  # one number per length

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, k) for t in batch["token"] for k in {*_heads(t), *(t[:n] for n in many if n < len(t))}], columns=["other", "head"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[shortened(a, b) for a, b in zip(batch["token"], batch["other"])]]

    words = tokens.where(F.length("token") > 1)
    short = words.select("token", F.when(F.length("token") > BRIEF, F.col("token")).otherwise(F.substring("token", 1, 3)).alias("head"))
    return short.join(words.mapInPandas(heads, "other string, head string"), "head").select("token", "other").mapInPandas(verify, "token string, other string")


def _initial(i: int, whole: list[str], j: int, other: list[str]) -> bool:
    """Whether the initial at ``i`` may stand for part ``j`` of the other name, both counted from the given name on.

    A leading initial stands for the leading part (or the last of two, as parts may be swapped), a later one for a
    middle part.
    """
    if i == 0:
        return j == 0 or len(other) == 2 and j == 1 and len(other[0]) > 1
    return 0 < j < len(other) - 1 or len(other[j]) == 1 and j > 0


def _likeness(i: int, whole_a: list[str], j: int, whole_b: list[str], firsts_a: set[str], firsts_b: set[str]) -> float:
    a, b = whole_a[i], whole_b[j]
    if len(a) > len(b):
        i, j, a, b, whole_a, whole_b, firsts_a, firsts_b = j, i, b, a, whole_b, whole_a, firsts_b, firsts_a
    if len(a) == 1:
        if not _initial(i, whole_a, j, whole_b):
            return 0.0
        return EQUAL if a == b else INITIAL if b[0] == a or any(f[0] == a for f in firsts_b) else 0.0
    if a == b:
        return EQUAL
    if firsts_a & (firsts_b | {b}) or a in firsts_b:
        return NICK
    if mistyped(a, b):
        return SLIP
    return SHORT if shortened(a, b) else 0.0


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float], firsts: dict[str, set[str]]) -> float:
    """Weighted share of the two names' parts that are alike.

    Each part is aligned with one of the other name, best first. Parts weigh by rarity. An initial that only one name
    has is passed over, as middle initials come and go; initials or words left on both sides contradict each other.

    A lone part is like no longer name, and like another lone part only if equal or mistyped. Of longer names
    one part of two or more letters must be equal or mistyped, unless they hold only initials: abbreviations and
    nicknames alone make different people alike (Gail Lohanzobu and L. Ganlilizi).
    """
    if len(a) == 1 or len(b) == 1:
        return EQUAL if a == b else SLIP if len(a) == len(b) and mistyped(a[0], b[0]) else 0.0
    none: set[str] = set()
    pairs = sorted(
        ((s, weight[x] + weight[y], i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := _likeness(i, a, j, b, firsts.get(x, none), firsts.get(y, none)))),
        key=lambda p: (-p[0] * p[1], p[2], p[3]),
    )
    free_a, free_b = set(range(len(a))), set(range(len(b)))
    got = whole = 0.0
    firm = not any(len(t) > 1 for t in (*a, *b))
    for s, w, i, j in pairs:
        if i in free_a and j in free_b:
            free_a.discard(i)
            free_b.discard(j)
            got += s * w
            whole += w
            firm = firm or len(a[i]) > 1 and (a[i] == b[j] or mistyped(a[i], b[j]))
    left_a, left_b = [a[i] for i in sorted(free_a)], [b[j] for j in sorted(free_b)]
    for one, other in ((left_a, left_b), (left_b, left_a)):
        for t in list(one):  # UP: University Press
            if 2 <= len(t) <= 4 and len(other) >= len(t):
                words = [next((w for w in other if w[0] == c), None) for c in t]
                if None not in words and len(set(words)) == len(t):
                    one.remove(t)
                    for w in words:
                        other.remove(w)
                    w = weight[t] + sum(weight[x] for x in words)
                    got, whole = got + SHORT * w, whole + w
    if left_a and left_b or not firm:
        return 0.0
    whole += sum(weight[t] for t in left_a + left_b if len(t) > 1)
    return got / whole if whole else 0.0


def _meeting_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(folded, one, two, taken, lead): the pairs of keys a name meets others on, one for each of two different parts.

    A part's own token is a key, and it takes the commoner tokens like it as keys; the first part only those a slip
    apart. The second part also takes the letters of its initials, and two further parts those of words given by initials. ``taken`` adds 2 if the first key
    is taken and 1 if the second is; of two like parts at most one has taken the key.

    ``lead`` marks the keys whose second part is the rarest one beside the first. Of two linked names one has no part
    left over, so its rarest part beside any other is alike in the other name: it is enough that one of the two leads.
    """
    for batch in batches:
        rows = []
        for folded, parts in zip(batch["folded"], batch["parts"]):
            tokens = [p["token"] for p in parts]
            words = [{t: 0} | dict.fromkeys(() if p["up"] is None else p["up"], 1) for t, p in zip(tokens, parts)]
            firsts = [[(k, 2 * f) for k, f in own.items() if not f or mistyped(t, k)] for t, own in zip(tokens, words)]
            if len(tokens) == 1:
                rows.extend((folded, k, "", f, True) for k, f in firsts[0])
                continue
            keys = []
            for t, p, own in zip(tokens, parts, words):
                letters = {} if len(t) == 1 else {x[0]: 1 for x in (t, *(() if p["firsts"] is None else p["firsts"]))}
                keys.append(letters | own | ({"^" + "".join(sorted(t[:2])): 0} if 2 <= len(t) <= 4 else {}))
            rare = sorted(range(len(tokens)), key=lambda j: (len(tokens[j]) == 1, -parts[j]["w"], tokens[j], j))
            found: dict[tuple, bool] = {}
            for i, t in enumerate(tokens):
                if len(t) > 1 or all(len(x) == 1 for x in tokens):
                    others = [j for j in range(len(tokens)) if j != i]
                    first = next(j for j in rare if j != i)
                    second = [(*k, j == first) for j in others for k in keys[j].items()]
                    second += {("^" + "".join(sorted(tokens[j][0] + tokens[k][0])), 1, True) for j in others for k in others if j < k}
                    for one, f in firsts[i]:
                        for two, g, lead in second:
                            at = (folded, one, two, f + g)
                            found[at] = found.get(at, False) or lead
            rows.extend((*at, lead) for at, lead in found.items())
        yield pd.DataFrame(rows, columns=["folded", "one", "two", "taken", "lead"])


def name_links(names: DataFrame, nicknames: Mapping[str, str] = NICKNAMES) -> tuple[DataFrame, DataFrame]:
    """(name, folded) per spelling and (a, b) per linked pair of different folded names, from distinct (name).

    ``nicknames`` has a first name's short forms, parted by blanks.
    """
    spellings = cut(names.mapInPandas(_fold_all, FOLDED).where("folded <> ''"))
    spark = names.sparkSession
    folded = spellings.select("folded").distinct()
    parts = cut(folded.select("folded", F.posexplode(F.split("folded", " ")).alias("i", "token")))
    counts = cut(parts.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    slips = token_slips(counts.select("token"))
    total = max(1, folded.count())
    long = slips.where((F.length("token") >= SEARCHED) & (F.length("other") >= SEARCHED))
    spread = long.join(counts.withColumnRenamed("token", "other"), "other").groupBy("token").agg(F.sum("n").alias("more"))
    usual = [(nick, first) for first, nicks in nicknames.items() for nick in nicks.split()]
    given = spellings.where("nick is not null").select(F.col("nick").alias("token"), "first").unionByName(spark.createDataFrame(usual, "token string, first string"))
    firsts = given.where("token <> first and length(first) > 1").groupBy("token").agg(F.collect_set("first").alias("firsts"))
    nicks = cut(firsts.select("token", F.explode("firsts").alias("first")))
    swap = lambda df: df.unionByName(df.select(F.col("other").alias("token"), F.col("token").alias("other")))
    same = nicks.join(nicks.select(F.col("token").alias("other"), "first"), "first").select("token", "other")
    kin = slips.unionByName(swap(token_shorts(counts.select("token")))).unionByName(same).unionByName(swap(nicks.select("token", F.col("first").alias("other")))).where("token <> other").distinct()
    ranked = kin.join(counts, "token").join(counts.select(F.col("token").alias("other"), F.col("n").alias("m")), "other")
    up = ranked.where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") > F.col("token")))).groupBy("token").agg(F.collect_list("other").alias("up"))
    known = counts.join(spread, "token", "left").join(firsts, "token", "left").join(up, "token", "left")
    seen = F.col("n") + F.coalesce("more", F.lit(0))
    weight = F.log(1 + F.lit(float(total)) / seen)
    small = F.length(F.concat_ws("", "token", "firsts", "up")) <= HOT_LETTERS
    known = cut(known.select("token", seen.alias("seen"), weight.alias("w"), "firsts", "up", ((F.col("n") > stored_rows(parts) * HOT) & small).alias("hot")))
    part = F.struct("i", "token", "w", "firsts", "up")
    whole = cut(lookup(parts, known, ["token"], "hot").groupBy("folded").agg(F.array_sort(F.collect_list(part)).alias("parts")))

    needed = whole.select("folded", F.expr("transform(parts, p -> struct(p.token, p.w, p.firsts, p.up))").alias("parts"))
    keyed = cut(needed.mapInPandas(_meeting_keys, "folded string, one string, two string, taken int, lead boolean"))
    left = keyed.where("lead").select(F.col("folded").alias("a"), "one", "two", F.col("taken").alias("ta"))
    right = keyed.select(F.col("folded").alias("b"), "one", "two", F.col("taken").alias("tb"))
    # Of two parts that are alike one is the key and the other takes it, so a common first name takes no others.
    pairs = left.join(right, ["one", "two"]).where("ta & tb = 0")
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = whole.select("folded", F.expr("transform(parts, p -> struct(p.token, p.w, p.firsts))").alias("parts"))
    pairs = pairs.join(full.select(F.col("folded").alias("a"), F.col("parts").alias("pa")), "a").join(full.select(F.col("folded").alias("b"), F.col("parts").alias("pb")), "b")

    @F.pandas_udf("boolean")
    def alike(pa: pd.Series, pb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(pa, pb):
            weights, known_firsts = {}, {}
            for p in (*x, *y):
                weights[p["token"]] = p["w"]
                if p["firsts"] is not None:
                    known_firsts[p["token"]] = set(p["firsts"])
            out.append(soft_similarity([p["token"] for p in x], [p["token"] for p in y], weights, known_firsts) >= THRESHOLD)
        return pd.Series(out)

    links = cut(pairs.where(alike("pa", "pb")).select("a", "b"))
    return spellings.select("name", "folded"), links


def variant_classes(names: DataFrame, column: str = "name", nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(name, class, links): each spelling, the class it belongs to, and how many folded names it is linked with.

    The class is named by its least folded name; a spelling without variants is alone in its class.

    Defined cases: null, blank and wordless names, and such that name nobody, are in no class. Repeated names count
    once. Other columns are never read. Without names there are no rows.
    """
    one = names.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct()
    spellings, links = name_links(one, nicknames)
    spellings = spellings.where(~F.col("folded").isin(*NOBODY))
    links = links.where(~F.col("a").isin(*NOBODY) & ~F.col("b").isin(*NOBODY))
    found = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    known = found.join(degree, "node")
    out = spellings.join(known, spellings["folded"] == known["node"], "left")
    return out.select("name", F.coalesce("component", "folded").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def variant_pairs(names: DataFrame, column: str = "name", nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(name_a, name_b) for every two different spellings of one class, ``name_a`` < ``name_b``."""
    classes = cut(variant_classes(names, column, nicknames).select("name", "class"))
    a, b = classes.select(F.col("name").alias("name_a"), "class"), classes.select(F.col("name").alias("name_b"), "class")
    return a.join(b, "class").where("name_a < name_b").select("name_a", "name_b")


def author_names(books: DataFrame) -> DataFrame:
    """Every name in the packed ``authors`` of all books, exactly as written."""
    return books.select("authors").where("authors is not null").distinct().select(F.explode(packed_values(F.col("authors"))).alias("name")).distinct()
