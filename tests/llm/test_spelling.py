"""Spelling variants against a plain search over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from mercata.llm import spelling

COLUMNS = "word string, n long"


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=5):
    best, n_near = {}, {}
    for w, n in counts.items():
        close = [o for o in counts if near(w, o)]
        n_near[w] = len(close)
        top = min(close, key=lambda o: (-counts[o], o), default=None)
        best[w] = top if top is not None and counts[top] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.add((w, best[w], root, n, n_near[w], counts.get(best[w])))
    return out


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abé", 2), ("aé😀", 3)])
def test_variants_equal_a_search_over_all_pairs(spark, letters, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choices(letters, k=rng.randint(0, 7))): rng.choice([1, 2, 5, 10, 25, 60, 130, 700]) for _ in range(150)}
    assert rows(spelling.variants(spark.createDataFrame(list(counts.items()), COLUMNS))) == plain(counts)


def test_ranges_share_the_nodes_of_their_common_prefixes(spark):
    """A trie numbered over many ranges has one number for each distinct prefix, and words are numbered in order."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(400)} | {"a" * 50, "a" * 51 + "b", "a" * 60})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long")
    for shuffles in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = spelling.number_trie(frame).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        node = {}
        for r in got:
            assert len(r.nodes) == len(r.w) + 1
            for k, x in enumerate(r.nodes):
                assert node.setdefault(r.w[:k], x) == x
        assert len(set(node.values())) == len(node)
        assert [r.w for r in sorted(got, key=lambda r: r.number)] == words and [r.i for r in sorted(got, key=lambda r: r.w)] == list(range(len(words)))


def test_counted_words(spark):
    rng = random.Random(5)
    runs = ["".join(rng.choices("abcdeÀéZ", k=rng.randint(4, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(runs, k=80)) + "-1x", i % 3) for i in range(120)]
    docs += [(7, docs[7][1], 0), (None, "Wintertime wintertime", 1), (500, None, 1), (501, "", 1), (502, "zz" * 60_000, 1), (503, "a1b2c3", 1)]
    expected = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string, n long")
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == expected
    assert rows(spelling.spelling_variants(frame)) == plain({w: n for w, n in expected.items() if n >= 5})


def test_chains_runs_ties_and_empty_tables(spark):
    """Forms are followed to the end; a letter of a run is inserted once; equal counts go to the smallest word; nulls and empty tables are harmless."""
    counts = {"balloon": 1000, "baloon": 100, "balon": 10, "walon": 10, "bbaloon": 100, "lonely": 3}
    frame = spark.createDataFrame([*counts.items(), (None, 4)], COLUMNS)
    got = rows(spelling.variants(frame))
    assert got == plain(counts)
    assert ("balon", "baloon", "balloon", 10, 2, 100) in got and ("lonely", None, "lonely", 3, 0, None) in got
    assert rows(spelling.variants(spark.createDataFrame([], COLUMNS))) == set()
    assert rows(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string, word string"))) == set()


def test_long_words(spark):
    """Work grows with the letters of a word, not with their square."""
    long = "ab" * 50_000
    counts = {long: 50, long[:-1]: 5, long[:70_000] + "x" + long[70_000:]: 3, "c" + long[1:]: 1}
    assert {(r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(counts.items()), COLUMNS)).collect()} == {(50, 3, None), (5, 1, 50), (3, 1, 50), (1, 1, 50)}
