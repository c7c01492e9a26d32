"""The divergence audit against plain sums over all terms."""

import re
from collections import Counter, defaultdict

import pytest

from paneflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top=50):
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in seen[lang].items() if n >= least) for lang, _ in groups}
    share = lambda n, size, v: 1 + 10**9 * (n + 5) // (size + 5 * v)
    p = {}
    for lang, source in groups:
        own, k = counts[lang, source], kept[lang]
        size = sum(own[t] for t in k)
        p[lang, source] = {t: share(own[t], size, len(k)) for t in k}
    out = []
    for lang, source in groups:
        k = kept[lang]
        total = Counter()
        for other in groups:
            if other[0] == lang:
                total.update({t: counts[other][t] for t in k})
        size = sum(total.values())
        pairs = [(sum(abs(p[lang, source][t] - p[g][t]) for t in k), g[1]) for g in groups if g[0] == lang and g[1] != source]
        high = [(p[lang, source][t] - share(total[t], size, len(k)), t) for t in k if counts[lang, source][t] > 0]
        for part, rows in (("pair", pairs), ("term", [x for x in high if x[0] > 0])):
            rows.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(rows, 1) if part == "pair" or i <= top]
    return sorted(out)


def audited(spark, docs, least, top=50):
    rows = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "text string, lang string, source string, n int, term string, terms int")
    return sorted(tuple(r) for r in divergence.audit(rows, least, top).collect())


def test_plain(spark):
    rng = __import__("random").Random(9)
    words = ["the", "of", "été", "Zug", "x1y", " ", "𝒳a", "A-b", "naïve", "rare"]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "\U0001f600", "￿", None, "c"])) for _ in range(300)]
    docs += [docs[0]] * 20 + [(None, "en", "empty"), ("", "zz", "alone"), ("!! 12", "yy", "p"), ("", "yy", "q")]
    assert audited(spark, docs, 5, 3) == plain(docs, 5, 3)
    assert audited(spark, docs, 10_000) == plain(docs, 10_000)


def test_one_term_in_all(spark):
    docs = [("same " * 50, "en", f"s{i}") for i in range(12)] + [("same other", "en", "s0")]
    assert audited(spark, docs, 1) == plain(docs, 1)


def test_empty(spark):
    rows = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(rows).count() == 0


@pytest.mark.parametrize("count,size,terms", [(0, 0, 1), (10**15, 2 * 10**15, 10**6), (7, 11, 3), (0, 0, 0), (123_456_789, 987_654_321, 55_555)])
def test_probability_is_exact(spark, count, size, terms):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.probability(F.lit(count).cast("long"), F.lit(size).cast("long"), F.lit(terms).cast("long"))).first()[0]
    assert got == (1 + 10**9 * (count + 5) // (size + 5 * terms) if terms else 1)


def test_buckets_do_not_change_the_tally(spark, monkeypatch):
    docs = [(f"alpha beta{i % 7} gamma{i % 3} " * (i % 5), "en", f"s{i % 4}") for i in range(200)]
    whole = audited(spark, docs, 3)
    monkeypatch.setattr(divergence, "PER_BUCKET", 2)
    monkeypatch.setattr(divergence, "GATHERED", 3)
    assert audited(spark, docs, 3) == whole == plain(docs, 3)
