import itertools
import math
import random
from collections import Counter

from trigraph.llm.variants import NICKNAMES, THRESHOLD, folded_name, mistyped, name_links, one_slip, shortened, soft_similarity, token_shorts, token_slips, variant_classes, variant_pairs


def frame(spark, names):
    return spark.createDataFrame([(n, "x", 1) for n in names], "name string, class string, links int")


def classes(spark, names):
    out = {}
    for r in variant_classes(frame(spark, names)).collect():
        out.setdefault(r["class"], set()).add(r.name)
    return sorted(map(sorted, out.values()))


def osa(a, b):
    if a == b:
        return True
    edits = set()
    for i in range(len(a) + 1):
        edits.add(a[:i] + a[i + 1 :])
        for c in set(b):
            edits |= {a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]}
        if i + 1 < len(a):
            edits.add(a[:i] + a[i + 1] + a[i] + a[i + 2 :])
    return b in edits


def test_fold():
    assert folded_name("Skvuisaran, Susannah D.") == "susannah d skvuisaran"
    assert folded_name('Dr. Edward "Ned" Brúskø, PhD') == "edward brusko"
    assert folded_name("The A & B Society") == "a b society"
    assert folded_name("...") == ""


def test_one_slip_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = rng.sample("abc", rng.randint(0, 2))
        b = "".join(b)
        assert one_slip(a, b) == osa(a, b), (a, b)


def test_slip_search_misses_nothing(spark):
    rng = random.Random(7)
    words = set()
    for _ in range(120):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(5, 9)))
        words.add(w)
        for _ in range(3):
            v = list(w)
            i = rng.randrange(len(v))
            kind = rng.randint(0, 3)
            if kind == 0:
                v[i] = rng.choice("abcd")
            elif kind == 1:
                v.insert(i, rng.choice("abcd"))
            elif kind == 2:
                del v[i]
            elif i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
            words.add("".join(v))
    words = sorted(w for w in words if len(w) >= 5)
    got = {tuple(r) for r in token_slips(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    want = {(a, b) for a in words for b in words if a != b and one_slip(a, b)}
    assert got == want


def test_similarity_rules():
    w = {t: 5.0 for t in "edward elias skudru a b e ned society museum soc railway up university press".split()}
    first = {"ned": {"edward"}}
    alike = lambda a, b: soft_similarity(a.split(), b.split(), w, first) >= 0.85
    assert alike("edward skudru", "e skudru") and alike("edward a skudru", "edward skudru") and alike("ned skudru", "edward skudru")
    assert not alike("edward skudru", "elias skudru") and not alike("edward a skudru", "edward b skudru") and not alike("a e skudru", "e a skudru")
    assert not alike("skudru railway society", "skudru railway museum") and alike("skudru railway soc", "skudru railway society")
    assert alike("skudru railway up", "skudru railway university press") and not alike("edward skudru", "skudru")


def test_people_and_organisations(spark):
    people = ["Isabel Hasorede", "Izzy Hasorede", "I. Hasorede", "Hasorede, Isabel", "ISABEL HASOREDE", "Isabel Hasoredé", "Isabel Hasroede", "Isbel Hasorede", "Dr. Isabel Hasorede", "Isabel K. Hasorede"]
    other = ["Tariq Hasorede", "T. Hasorede"]
    orgs = ["Gizitako & Vadamefu Geological Society", "Gizitako and Vadamefu Geological Society", "Gizitako & Vadamefu, Geological Society", "The Gizitako & Vadamefu Geological Soc.", "Gizitaok & Vadamefu Geolo. Soc"]
    alone = ["Gizitako Railway Society", "Zoran Pelikrabo"]
    filler = [f"{f} {s}" for f in ("Isabel", "Tariq", "Noor", "Liam") for s in ("Brevostan", "Dukkeliza", "Fanterigo", "Gamoltusi", "Hirpedona", "Jelvukara", "Komsitreb")]
    names = people + other + orgs + alone + ["Anonymous", "VARIOUS", "", None, "  ", "?!"]
    got = classes(spark, names + filler + people[:3])
    assert sorted(people) in got and sorted(other) in got and sorted(orgs) in got
    assert all([a] in got for a in alone) and all([f] in got for f in filler)
    assert not any("Anonymous" in c or "VARIOUS" in c for c in got)


def test_pairs_of_a_class_and_empty_input(spark):
    got = sorted(tuple(r) for r in variant_pairs(frame(spark, ["Una Kibrudegli", "UNA KIBRUDEGLI", "U. Kibrudegli", "Other Person"])).collect())
    assert got == [("U. Kibrudegli", "UNA KIBRUDEGLI"), ("U. Kibrudegli", "Una Kibrudegli"), ("UNA KIBRUDEGLI", "Una Kibrudegli")]
    assert variant_pairs(frame(spark, [])).count() == 0
    assert classes(spark, ["x" * 50_000 + " long", "a" * 5 + " b"]) != []


def all_links(names):
    """Links of folded names by comparing all with all; no name may hold a quoted nickname."""
    folded = sorted({folded_name(n) for n in names} - {""})
    n = Counter(t for f in folded for t in f.split())
    long = [t for t in n if len(t) >= 5]
    seen = n + Counter({t: sum(n[o] for o in long if o != t and one_slip(t, o)) for t in long})
    weight = {t: math.log(1 + len(folded) / seen[t]) for t in n}
    firsts = {}
    for first, nicks in NICKNAMES.items():
        for nick in nicks.split():
            firsts.setdefault(nick, set()).add(first)
    return {(a, b) for a, b in itertools.combinations(folded, 2) if soft_similarity(a.split(), b.split(), weight, firsts) >= THRESHOLD}


def test_links_of_frequent_and_short_surnames_against_all_pairs(spark):
    rng = random.Random(5)
    given = "Liam Laim Christopher Chris C. Xavier X. Ted Edward Theodore T. Al Alexander Noor Nor Isabel Izzy I. Bo Jo Josephine Geoffrey Wolfgang Wolfga".split()
    common = [f"{''.join(rng.choice('bdfgklmnrtvz') + rng.choice('aeiou') for _ in range(4)).title()} Smith" for _ in range(80)]
    names = common + [f"{g} {m}{s}" for g in given for s in "Smith Smiht Lee Lea Kim Ng Li Ling Lindgren".split() for m in ("", rng.choice(["K. ", "Ann ", "Skudru "]))]
    names += ["Smith", "Lee", "Leee", "J. R.", "J. R. R.", "Lee Railway UP", "Lee Railway University Press", "Smith Geolog Society", "Smith Geological Soc", "Gail Lohanzobu", "L. Ganlilizi"]
    got = {tuple(r) for r in name_links(spark.createDataFrame([(n,) for n in names], "name string"))[1].collect()}
    assert got == all_links(names)
    for pair in (("laim smith", "liam smith"), ("x smith", "xavier smith"), ("c lee", "christopher lee"), ("chris lee", "christopher lee"), ("c ng", "chris ng")):
        assert pair in got, pair


def test_short_slips_and_shortened_words_against_all_pairs(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "token string")
    assert {tuple(r) for r in token_slips(df).collect()} == {(a, b) for a in words for b in words if a != b and mistyped(a, b)}
    assert {tuple(r) for r in token_shorts(df).collect()} == {(a, b) for a in words for b in words if len(a) > 1 and shortened(a, b)}
