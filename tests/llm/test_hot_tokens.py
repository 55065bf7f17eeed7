from trigraph.llm import variants


def test_what_is_sent_to_all_is_bounded(spark, monkeypatch):
    """A nickname that very many first names have is frequent, but too long to be broadcast with them."""
    letters = [chr(97 + i) for i in range(26)]
    firsts = [f"{a}{b}{c}orvellan" for a in letters for b in letters[:13] for c in letters[:4]]
    names = [f'{f.title()} "Ned" Skudru{f[:3]}' for f in firsts] + [f"Ned Brevo{a}{b}" for a in "aeiou" for b in letters[:4]] + [f"{firsts[0].title()} Brevoaa"]
    sent = []

    def lookup(many, one, on, hot):
        sent.extend(one.where(hot).select("token", "firsts", "up").collect())
        return real(many, one, on, hot)

    real = variants.lookup
    monkeypatch.setattr(variants, "lookup", lookup)
    links = {tuple(r) for r in variants.name_links(spark.createDataFrame([(n,) for n in names], "name string"))[1].collect()}
    assert (f"{firsts[0]} brevoaa", "ned brevoaa") in links
    assert all(sum(map(len, [r.token, *(r.firsts or []), *(r.up or [])])) <= 10_000 for r in sent)
