"""Source divergence against plain counting in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mercata.llm import divergence

SCHEMA = "lang string, source string, text string, term string, n long"


def plain(docs, least=3, ranks=200):
    lowered = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for lang, source, text, *_ in docs]
    held, counts, totals = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, _, found in terms:
        held[lang].update(set(found))
    for lang, source, found in terms:
        kept = [t for t in found if held[lang][t] >= least]
        counts[lang, source].update(kept)
        totals[lang].update(kept)
    p = lambda c, t, v: 1 + 10**9 * (c[t] + 1) // (c.total() + v)
    out = set()
    for lang, source in counts:
        words = list(totals[lang])
        v = len(words)
        others = []
        for l2, other in counts:
            if l2 == lang and other != source:
                pairs = [(p(counts[lang, source], t, v), p(counts[lang, other], t, v)) for t in words]
                others.append((other, sum((a - b) ** 2 // b for a, b in pairs)))
        own = [(t, p(counts[lang, source], t, v), p(totals[lang], t, v)) for t in counts[lang, source]]
        own = [(t, (a - b) ** 2 // b) for t, a, b in own if a > b]
        for part, items in (("pair", others), ("term", own)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1) if part == "pair" or i <= ranks}
    return out


def rows(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("most_terms", [1_000_000, 20])
def test_divergence_equals_plain_counting(spark, most_terms):
    rng = random.Random(1)
    words = [w + x for w in ("Haus", "ÉTÉ", "été", "naïve", "lake", "Ωmega", "x") for x in ("", "s", "Z", "日本")]
    docs = [
        (rng.choice(["en", "de", None, "a b"]), rng.choice(["s1", "s2", "s2", "s2", "", None, "s 3"]), rng.choice([" ", "-", "\n", "\x7f9"]).join(rng.choices(words, k=rng.randint(0, 40))), "clash", i)
        for i in range(150)
    ]
    docs += docs[:20]
    docs += [("zz", "only", "rare words here", "", 1), ("zz", "other", None, "", 2), ("fr", "alone", "un un un", "", 3), ("en", "none", "", "", 4), ("en", "long", "lake " * 30_000, "", 5)]
    docs += [("ties", s, "b a é b a é", "", 6) for s in ("s1", "s1", "s1", "s2")] + [("ties", "s2", "c c c", "", 7)] * 3
    frame = spark.createDataFrame(docs, SCHEMA)
    assert rows(divergence.divergence(frame, most_terms=most_terms)) == plain(docs)
    assert rows(divergence.divergence(frame, least_docs=1, ranks=3)) == plain(docs, 1, 3)


def test_shares_part_the_vocabulary(spark):
    """Any number of shares counts the same; condensed documents keep which terms stand in enough documents, whatever a task holds at once."""
    docs = [("en", f"s{i % 3}", " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i, i + 300))) for i in range(30)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    read = divergence._read(frame, "lang", "source", "text")
    groups = spark.createDataFrame([(i, "en", f"s{i}") for i in range(3)], "gid long, lang string, source string")
    told = []
    for most in (10**6, 64):
        counts, names = divergence.count_terms(read, groups, 3, most)
        told.append(sorted((r.term, r.gid, r.n) for r in counts.join(names, "tid").collect()))
    assert told[0] == told[1] and len(told[0]) > 300
    held = Counter(w for _, _, t in docs for w in set(t.split()))
    for most in (500_000, 10):
        got = Counter(t.split("|")[1] for r in divergence.condensed(read, 4, most).collect() for t in r.terms.split(" "))
        assert {w for w, n in got.items() if n >= 4} == {w for w, n in held.items() if n >= 4}


def test_documents_of_a_group_are_counted_as_runs(spark):
    """The rows to be counted follow groups and buckets, not documents; they hold every occurrence, whatever a task or a row holds at once."""
    docs = [(("en", "de")[i % 2], f"s{i % 3}", f"the The thé x{i % 7}y, lake" + " z" * (i % 50)) for i in range(2000)] + [("en", "s0", ""), ("en", "s0", "42")]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").coalesce(1)
    read = divergence._read(frame, "lang", "source", "text")
    told = Counter((lang, source, t) for lang, source, text in docs for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("T", "t")))
    for most, longest in ((500_000, 100_000), (500_000, 30), (5, 100_000)):
        runs = divergence.dealt(read, 3, most, longest).where("part = 0").collect()
        assert Counter((r.lang, r.source, t.split("|")[1]) for r in runs for t in r.terms.split(" ")) == told
        assert all(t.split("|")[0] == r.lang.encode().hex() and divergence._bucket(t.split("|")[1].encode()) == r.bucket for r in runs for t in r.terms.split(" "))
        assert max(len(r.terms.split(" ")) for r in runs) <= longest
        if (most, longest) == (500_000, 100_000):
            assert len(runs) <= len(told) < 50


def test_counts_beyond_a_long_when_scaled(spark):
    row = spark.range(1).selectExpr("9000000000000000 AS n", "9500000000000000 AS n_all", "7 AS v").selectExpr(f"{divergence._p('n', 'n_all')} AS p").first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 1) // (95 * 10**14 + 7)


def test_empty_table(spark):
    assert rows(divergence.divergence(spark.createDataFrame([], SCHEMA))) == set()
