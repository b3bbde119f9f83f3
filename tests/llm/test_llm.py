"""The training-data operators against brute force, exact tokenizers and planted cases."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm import common, decontaminate, html_text, licenses, mixing, near_copies, queries, secrets, simhash, token_counts, toxicity, url_filter, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lake river stone cloud amber field winter music paper garden silver market table window candle forest bridge harbor engine letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def reach(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


# 1 ----------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://example.com/en/", "ftp://a.net/es/q", "x.net/es/", None, "http://Ünet/fr/", "a://b?c://d/", "http://xexample.com/en/1"]
    pages = spark.createDataFrame([(i, u, 7, "keep") for i, u in enumerate(urls)], "page_id int, url string, _listed int, host string")
    none = spark.createDataFrame([], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none).collect()}
    assert {"_listed", "listed"} <= set(url_filter.filter_urls(pages.withColumn("listed", F.lit(1)), none).columns)
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("net/es/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow") and got[5][:2] == ("Ünet", "/fr/")
    assert got[6][:2] == ("b", "") and got[7][2:] == ("com/", "allow")


@pytest.mark.parametrize("most_bits", [1 << 20, 640])
def test_cascade_is_exact_over_its_universe(spark, most_bits):
    keys = [f"k{i}" for i in range(3000)]
    listed = {k for k in keys if hash_of(k) % 9 == 0}
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), ("k1",)], "key string")
    cascade = url_filter.build_cascade(universe, universe.where(F.col("key").isin(*listed)), bits_per_key=4, hashes=2, most_bits=most_bits)
    assert (len(cascade.shards) > 1) == (most_bits == 640) and max(map(len, cascade.shards)) > 1
    got = {r.key for r in cascade.mark(universe, "key", "hit").where("hit").collect()}
    assert got == listed
    plan = cascade.mark(universe, "key", "hit")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def hash_of(s):
    return int(hashlib.md5(s.encode()).hexdigest(), 16)


def test_empty_list_blocks_nothing(spark):
    cascade = url_filter.build_cascade(spark.createDataFrame([], "key string"), spark.createDataFrame([], "key string"))
    assert spark.range(1).select(cascade.listed(F.lit("x"))).first()[0] is False


# 2 ----------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60) if i % 3 else " ".join(w + "###" for w in prose(rng, 40).split()) for i in range(240)] + [None, ""]
    docs = docs_of(spark, texts).withColumn("rate", F.lit("clash")).withColumns({"x": F.lit(1), "p": F.lit(2), "features": F.lit(3)})
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, mixing.QUALITY_DOMAINS, {"prose": 0.5, "poor": 0.5}).collect()
    assert len(out) == 242 and {(r.x, r.p, r.features) for r in out} == {(1, 2, 3)}
    totals = np.sum([np.array(r.posteriors) * r.rate * r.tokens for r in out], axis=0)
    assert totals / totals.sum() == pytest.approx([0.5, 0.5], abs=1e-4)
    assert min(r.rate for r in out) >= 0 and [r.tokens for r in out if not r.text] == [0, 0]
    assert np.mean([np.argmax(r.posteriors) == int(r.doc_id % 3 != 0) for r in out if r.text]) > 0.95
    assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in out)


def test_mixing_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs_of(spark, []), empty).count() == 0
    assert mixing.mix(docs_of(spark, ["a b"]), empty).first().rate >= 0


# 3 ----------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    for k in range(60):
        words = texts[k % 12].split()
        for _ in range(k // 12):
            words[rng.randrange(len(words))] = "edit" + str(rng.random())
        texts.append(" ".join(words))
    return texts + ["", None, "One", "one ", "É\x0bX", texts[0], texts[0]]


@pytest.mark.parametrize("wide", [8192, 2])
def test_simhash_components_match_brute_force(spark, wide):
    texts = near_texts()
    prints = [plain_fingerprint(t) for t in texts]
    want = reach(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r.id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs_of(spark, texts), wide=wide).collect()}
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, want))}


@pytest.mark.parametrize("wide", [8192, 3])
def test_simhash_links_of_tight_clusters(spark, wide):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(120):
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), wide=wide).collect()
    linked = {frozenset((r.a, r.b)) for r in edges}
    want = reach(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert reach(len(prints), lambda i, j: frozenset((signed[i], signed[j])) in linked) == want


def test_simhash_nulls_repeats_and_keep(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, None), (6, ""), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (5, 5), (6, 5), (None, None)], key=str)
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["3", "5", "None", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
def test_texts_that_share_an_id_are_not_lost(spark, keep_one):
    a, b = "a text about lakes and stones", "another one of music and paper"
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b, "s"), (3, b, "s"), (3, "third words stand here alone", "t"), (None, a, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, several_id string").withColumn("id", F.lit(0)).withColumn("key", F.lit("k"))
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.several_id) for r in got.collect()) == sorted([("1", a, "p"), ("1", b, "q"), ("3", "third words stand here alone", "t"), ("None", a, "u")])
    assert keep_one(docs.limit(0)).count() == 0


def test_components_of_ids_with_several_texts(spark):
    rows = [(1, "a b c d e"), (1, "f g h i j"), (2, "a b c d e"), (3, "f g h i j"), (4, "k l m n o")]
    got = sorted((r.id, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(4)
    for _ in range(300):
        a = {rng.getrandbits(63) for _ in range(rng.randint(0, 400))}
        b = set(rng.sample(sorted(a), len(a) // 2)) | {rng.getrandbits(63) for _ in range(rng.randint(0, 300))}
        x, y = (near_copies.sketch(np.array(sorted(v), np.int64)) for v in (a, b))
        assert near_copies.differing_bits(x, y) <= len(a ^ b)


def test_scratch_tables_go(spark, tmp_path):
    with common.scratch(spark):
        gone, kept = common.cut(spark.range(3)), common.cut(spark.range(4), keep=True)
        paths = [df.inputFiles()[0][7:] for df in (gone, kept)]
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 4


def plain_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_match_brute_force_jaccard(spark):
    rng = random.Random(14)
    texts = near_texts() + [" ".join("same line that many documents hold among other things".split() + prose(rng, rng.randint(0, 30)).split()) for _ in range(20)]
    for k in range(80):  # one to six edits of 60 to 200 words: around a similarity of 0.8
        words = prose(rng, rng.randint(60, 200)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = "edit" + str(rng.random())
        texts.append(" ".join(words))
    sets = [plain_shingles(t) for t in texts]
    close = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = reach(len(texts), close)
    beyond = [(i, j) for i in range(len(texts)) for j in range(i) if close(i, j) and (plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 4]
    assert len(beyond) > 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    kept = [r.doc_id for r in near_copies.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([*{c for c in want}, None], key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(edges.union(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))).collect()
    assert {r.component for r in got if r.node <= 200} == {1} and {r.component for r in got if r.node > 200} == {500}


# 4 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [8000, 20])
def test_vectors_match_brute_force(spark, cell_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [*base, *(base[:20] + 0.02 * rng.standard_normal((20, 16))), *(base[0] + 0.06 * rng.standard_normal((60, 16))), base[3], base[3] * 2]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [None] + [1.0] * 15]
    data = [(i, v.tolist(), i % 2) for i, v in enumerate(rows)] + [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0].tolist(), None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    n = len(rows)
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None] % 2)
    np.fill_diagonal(close, False)
    root = reach(n, lambda i, j: close[i, j])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, cell_rows=cell_rows).collect()}
    want = {i: (int(close[i].sum()), root[i], root[i] == i) for i in range(n)} | {i: (0, i, True) for i in (*range(1000, 1006), 2000)}
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [8000, 1])
def test_vectors_of_repeated_ids_keep_their_own_links(spark, cell_rows):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 1.001]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, rep string, class int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(df, cell_rows=cell_rows).collect())
    assert got == [("3", 1, "3", True), ("5", 1, "3", False), ("5", 2, "3", False), ("7", 2, "3", False), ("8", 2, "3", False), ("None", 0, "None", True)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("key", list(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, key):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    theirs = con.execute(queries.oracle_sql()[key])
    names = [d[0] for d in theirs.description]
    got = queries.queries()[key](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(theirs.fetchall(), key=str)


def test_range_join_of_a_block_is_complete():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 8):
        x = np.concatenate((rng.standard_normal((300, dim)) * 0.1, np.full((20, dim), 0.05)))
        got = [(min(i, j), max(i, j)) for a, b in vectors.block_pairs(x, 0.07, chunk=16) for i, j in zip(a.tolist(), b.tolist())]
        gap = ((x[:, None] - x[None]) ** 2).sum(2)
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if gap[i, j] <= 0.07**2}
        assert len(got) == len(set(got)) and want <= set(got) and all(gap[i, j] <= 0.07**2 + 2e-5 for i, j in got)


# 5 ----------------------------------------------------------------------------------------------


def test_grammar_scores_clauses():
    score = toxicity.Scorer(toxicity.Lexicon.fixed())
    assert score("The weather is fine.") == 0 and score(None) == 0 and score("") == 0
    assert score("You are a worthless liar.") >= 0.7 > score("You are not a liar.") and score("Worthless, you.") >= 0.7
    for words in ("Take out the trash.", "The fool on the hill smiled.", "Idiot!", "He said the man was stupid.", "kill the process", "I will not hurt you"):
        assert 0 < score(words) < 0.7, words
    for words in ("I will kill you.", "You, I will kill you and destroy you.", "you shall burn", "Te voy a matar.", "Ich werde dich umbringen"):
        assert score(words) >= 0.7, words
    assert score("An idiotic plan; a moron.") > score("A moron.") and score("paramorons here") == 0
    assert score("x " * 50000 + "you scum") >= 0.7
    learned = toxicity.Scorer(toxicity.Lexicon(toxicity.Lexicon.fixed().terms | {"clown*": ("I", 0.97)}))
    assert learned("The clown smiled.") >= 0.7 > learned("Not a clown.")


def test_composed_machine_equals_its_parts():
    import itertools

    def plain(symbols):
        left, report, seen, out = 0, False, set(), []
        for s in symbols:
            said, factor = s, 1.0
            if s in "IH" and left:
                said, factor = s.lower(), factor * 0.4
            left = 3 if s == "N" else max(0, left - 1)
            if said in "IH" and report:
                said, factor = said.lower(), factor * 0.5
            report = report or s == "R"
            seen.add(s)
            out.append((said, factor))
        end = "E" if "Y" not in seen else {(0, 0): "A", (1, 0): "B", (0, 1): "T", (1, 1): "C"}["I" in seen, "H" in seen]
        return [*out, (end, 1.0)]

    table = toxicity.GRAMMAR.table(toxicity.ALPHABET)
    for symbols in itertools.product("IHYNRw", repeat=5):
        state, got = 0, []
        for s in [*symbols, "E"]:
            state, said, factor = table[state, s]
            got.append((said, factor))
        assert [(a, pytest.approx(f)) for a, f in plain(symbols)] == got and state == 0


def test_toxicity_learns_stems_from_its_fold(spark):
    import zlib

    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = "grumpel" + rng.choice("abcdef") + str(rng.randint(0, 999))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = docs_of(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(602))
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert got[600].score == got[601].score == 0
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i in got if not got[i].predicted}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).count() == 602
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_copies_are_one_witness(spark):
    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(10)]
    copies = [texts[0].replace(" ", " ", 1) + f" end{i}" for i in range(20)] + [texts[1]] * 5
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + copies)], "doc_id long, text string, toxic int")
    assert 10 <= toxicity.without_copies(rows).count() <= 12


def test_longer_stems_win():
    found = {"lose*": (50, 9), "loser": (45, 0), "vequ*": (40, 0), "vequa*": (12, 0), "lost*": (30, 0), "lostra*": (30, 0)}
    assert [t for t in found if not toxicity._outdone(t, found)] == ["loser", "vequ*", "vequa*", "lostra*"]


# 6 ----------------------------------------------------------------------------------------------

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def plain_secrets(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    spans.sort()
    line = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
    return (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(line.encode()).hexdigest(), line)


def test_secrets_match_plain_patterns(spark):
    rng = random.Random(5)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [
        None, "", "é token = \"" + hexes + "\" und password=abc", "PassWord: x secret:'abcdef' api_key=A.b-c_9", "AKIA" + "Z9" * 8 + " AKIA123 xAKIA" + "Q" * 30,
        "password=token: abcdefgh", hexes[:23] + "g" + hexes[:24], "token=abcdef " * 700, "secret = = x", "😀" * 5 + "passwd:123456", "a" * 30 + "0" * 25,
    ]
    got = {r.doc_id: r for r in secrets.secret_digest(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_secrets(t)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[:4], t
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("entropy")) == want[4]


def test_entropy_finds_random_strings_only(spark):
    rng = random.Random(6)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    texts = [f"see {key} here", "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_words_2020", "x1" * 20, f"example{key}", f"token={key}"]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(docs_of(spark, texts)).collect()}
    assert got[0] == "entropy:4:44" and [got[i] for i in range(1, 5)] == [""] * 4 and got[5] == "assign:0:46"


def test_window_entropy_is_exact(spark):
    word = "aB3dE5aB3dE5zzzzzzzzzz0123456789abcdefXYZ"

    def h(w):
        return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))

    got = spark.range(1).select(secrets.window_entropy(F.lit(word))).first()[0]
    assert got == pytest.approx(max(h(word[i : i + 20]) for i in range(len(word) - 19)))


def test_redaction(spark):
    docs = docs_of(spark, ["é token=abcdefgh and AKIA" + "A1" * 8, "clean", None])
    got = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs)).collect()}
    assert got == {0: "é [SECRET] and [SECRET]", 1: "clean", 2: None}


# 7 ----------------------------------------------------------------------------------------------


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(7)
    items = [prose(rng, n) for n in (40, 30, 15, 8, 25)] + ["", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    edited = items[0].upper().split()
    for k in (5, 17, 29):
        edited[k] = "other"
    texts = [f"{prose(rng, 50)} {t} {prose(rng, 50)}" for t in (items[0], " ".join(edited), items[2], items[3])]
    texts += [prose(rng, 100), None, "", items[1], " ".join(items[4].split()[:6]), texts[0] + " " + items[0]]
    docs = docs_of(spark, texts).withColumn("row", F.lit(1)).withColumn("h1", F.lit("x"))
    for bits in (1 << 27, 1 << 12):
        got = {(r.doc_id, r.item_id): r.n_overlap for r in decontaminate.contaminated(docs, bench, most_bits=bits).collect()}
        assert got == {(0, 0): 40, (1, 0): 37, (2, 2): 15, (3, 3): 8, (7, 1): 30, (9, 0): 40}
        kept = decontaminate.drop_contaminated(docs, bench, most_bits=bits)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 8}
    short = spark.createDataFrame([(0, texts[4].split()[0]), (1, " ".join(texts[4].split()[:7]))], "item_id long, text string")
    assert decontaminate.contaminated(docs, short).count() == 0 and decontaminate.drop_contaminated(docs, short).count() == len(texts)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def best_overlap(doc, item):
    """Most agreeing tokens of a segment of one shift that reaches 80 %, by trying all."""
    best = 0
    for shift in range(1 - len(item), len(doc)):
        low, high = max(0, shift), min(len(doc), shift + len(item))
        same = [doc[i] == item[i - shift] for i in range(low, high)]
        if sum(same) > best:
            for a in range(len(same)):
                n = 0
                for b in range(a, len(same)):
                    n += same[b]
                    if 5 * n >= 4 * (b + 1 - a):
                        best = max(best, n)
    return best


def test_masks_hit_every_smallest_overlap():
    from itertools import combinations

    for length, differing in ((13, 0), (14, 1), (15, 2), (16, 3), (20, 4), (25, 5), (30, 6)):
        words = np.array([(1 << length) - 1 - sum(1 << x for x in c) for c in combinations(range(length), differing)])
        hit = np.zeros(len(words), bool)
        for seed in decontaminate.SEEDS:
            mask = int(seed[::-1], 2)
            for at in range(length - len(seed) + 1):
                hit |= words & (mask << at) == mask << at
        assert hit.all(), (length, differing)


def test_decontamination_matches_brute_force_at_the_edge(spark):
    rng = random.Random(15)
    items = [prose(rng, n) for n in (*range(1, 21), 26, 34, 48, 60, 17, 62)]
    texts = []
    for i, item in enumerate(items[:-2]):
        for k in range(8):
            words = item.split()
            allowed = len(words) // 5 + k % 2  # at the edge of 80 %, and one beyond
            for at in rng.sample(range(len(words)), min(len(words), allowed)):
                words[at] = "other"
            texts.append(f"{prose(rng, 12)} {' '.join(words)} {prose(rng, 12)}")
    late = items[-2].split()
    late[12] = "other"
    far = items[-1].split()
    far[12:32] = ["other"] * 20
    texts += [prose(rng, 9) + " " + " ".join(late), " ".join(far)]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            n, size = best_overlap(text.split(), item.split()), len(item.split())
            if n >= min(13, -(-4 * size // 5)):
                want[d, None if i == 5 else i] = n
    assert want[len(texts) - 2, len(items) - 2] == 16 and want[len(texts) - 1, len(items) - 1] == 30
    bench = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_overlap for r in decontaminate.contaminated(docs_of(spark, texts), bench, least=1).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, texts), bench, least=1).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


# 8 ----------------------------------------------------------------------------------------------


def test_license_families(spark):
    rng = random.Random(8)
    stated = {
        0: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), 1: ("Released under the MIT License.", "mit"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), 3: ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        4: ("All of it is licensed under a plan of our own.", "unknown"),
        5: ("He lost his driving license in May.", None), 6: ("The licensing of fishermen takes a year.", None),
    }
    texts = [f"{prose(rng, 20)}\n{stated[i][0]}\n{prose(rng, 20)}" for i in range(7)] + [prose(rng, 30) for _ in range(40)] + [None, ""]
    docs = docs_of(spark, texts)
    model = licenses.train(docs)
    got = {r.doc_id: (r.paragraph, r.family) for r in licenses.scan_licenses(docs, model).collect()}
    assert got == {i: (1, f) for i, (_, f) in stated.items() if f}
    every = licenses.LicenseModel(model.families, model.vocabulary, model.weights, model.bias, model.temperature, model.threshold, model.shapes)
    every.needed = lambda: ["[^\\p{L}\\p{N}]?"]  # no word test: the same rows
    assert {r.doc_id for r in licenses.scan_licenses(docs, model).collect()} == set(got)


def test_licenses_close_to_a_family_are_unknown(spark):
    """Other versions and relatives of a known license, and sentences that share its words, never get its family."""
    rng = random.Random(21)
    told = [
        ("This work is licensed under the GNU General Public License, version 2.", "unknown"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "unknown"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under CC BY 4.0.", None), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "unknown"), ("Released under the ISC License.", "unknown"), ("Released under the MIT License.", "mit"),
        ("The new law was released under the MIT chairman.", None), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: Zlib", "unknown"), ("Licensed under the Apache License, Version 1.1.", "unknown"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ]
    docs = docs_of(spark, [t for t, _ in told] + [prose(rng, 40) for _ in range(60)])
    got = {r.doc_id: r.family for r in licenses.scan_licenses(docs, licenses.train(docs)).collect()}
    for i, (text, family) in enumerate(told):
        assert got.get(i) in ((family,) if family else (None, "unknown")), text
    assert set(got) <= set(range(len(told)))


def test_licenses_wrapped_over_lines(spark):
    rng = random.Random(18)
    grant = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files, to deal in the\nSoftware without restriction"
    texts = [
        f"{prose(rng, 20)}.\n\n{grant}, in full.\n{prose(rng, 20)}", f"A title\nReleased under the\nMIT License.\n\nReleased under the MIT License.", grant.replace("\n", " "),
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n" + "x\n" * 3000, "the city released\nunder the rain\nits driving license",
    ]
    docs = docs_of(spark, texts + texts[2:3] + [prose(rng, 30) for _ in range(40)])
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan_licenses(docs, licenses.train(docs)).collect())
    assert got == [(0, 2, "mit"), (1, 0, "mit"), (1, 4, "mit"), (2, 0, "mit"), (3, 0, "apache-2.0"), (3, 1, "mit"), (5, 0, "mit")]


# 9 ----------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="needs a vocabulary file")
def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    bytes_ = [(f"<0x{b:02X}>", -1e9) for b in range(256)]
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *bytes_, *pieces], unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    rng = random.Random(10)
    texts = [prose(rng, 80), "", None, " ", "two  spaces", "def f():\n    return  x", "   lead", "trail   ", " " * 40, "Ünïcödé ñandú 漢字 😀😀 x", "line\nbreak\ttab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "▁already ▁marked"]
    texts += ["".join(rng.choice("abcdeéñ ßöü漢\n") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, texts), pieces).collect()}
    assert got == {i: len(exact.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}


def test_long_words_are_counted_in_little_memory():
    import tracemalloc

    counter = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -1.5), ("▁▁", -1.2)])
    tracemalloc.start()
    assert counter.count("a" * 400_000) == 200_001 and counter.count("a  a") == 5 - 1
    assert tracemalloc.get_traced_memory()[1] < 16_000_000
    tracemalloc.stop()


def test_ties_take_the_longest_last_piece():
    counter = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], byte_fallback=False)
    assert counter.count("ab") == 2 and counter.count("zz") == 2 and counter.count("azza") == 3


# 10 ---------------------------------------------------------------------------------------------


def page(body, nav="Home", extra=""):
    return f"<html><head><title>t</title></head><body><nav><ul><li>{nav}</li></ul></nav>{body}{extra}<footer>&copy; x</footer></body></html>"


def test_article_text(spark):
    html = page("<div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one  two\n three<br><p>x&nbsp;y</p><div class='comments'><p>bad</p></div></article>")
    rows = [(1, "http://a.com/x/1", html), (2, "http://a.com/x/2", page("<article><p>other</p></article>")), (3, None, None), (4, "http://b.com/", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[1].n_deleted > 0  # adverts and comments go though its one neighbour has neither
    assert got[1].text == "A & B\n\none two three\n\nx y"
    assert got[2].text == "other" and got[3].text == "" and got[4].text == ""
    again = spark.createDataFrame([(i, f"http://a.com/x/{i}", html) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract_text(again).collect()} == {"A & B\n\none two three\n\nx y"}
    assert html_text.extract_text(again.limit(1)).first().text == "A & B\n\none two three\n\nx y"
    assert html_text.extract_text(again.limit(0)).count() == 0


def test_neighbours_decide_on_hinted_elements():
    lines = html_text.lines_of(page("<article><p class='search-term'>kept</p><div class='share-price'>Price 3</div><p>text</p></article><div class=ad>buy</div>"))
    keys = [k for k, _ in html_text.outline(lines)]
    assert html_text.main_text(lines, [])[0] == "kept\n\nPrice 3\n\ntext"
    assert html_text.main_text(lines, [keys])[0] == "kept\n\ntext"
    assert html_text.main_text(lines, [[k for k in keys if k != "x:div.share"]])[0] == "kept\n\nPrice 3\n\ntext"


@pytest.mark.parametrize(
    "body, text",
    [
        ('<article class="post category-social"><p>told</p></article>', "told"),
        ('<div class="post related-news-body"><p>told</p></div>', "told"),
        ('<div class="layout with-sidebar"><article><p>told</p></article></div>', "told"),
        ('<div class="page has-comments"><main><p>told</p></main></div>', "told"),
        ('<div class="related-page"><p>told</p></div>', "told"),
        ('<article><p>told</p></article><ol class="commentlist"><li><article class="comment"><p>bad</p></article></li></ol>', "told"),
        ('<main><section class="comments"><p>bad</p></section><div class="ad">BUY NOW</div><p class="ad">buy</p><p>told</p></main>', "told"),
        ("<article><p>a</p></article><div>" + "x" * 2 + "</div>", "a"),
        ("<article><p>aa</p></article><div>x</div>", "aa"),
        ("<p>one</p><aside><article><p>teaser</p></article></aside><p>two</p>", "one\n\ntwo"),
    ],
)
@pytest.mark.parametrize("alone", [True, False])
def test_no_hint_deletes_an_article_and_adverts_and_comments_go(body, text, alone):
    assert html_text.main_text(html_text.lines_of(page(body)), [], alone)[0] == text


@pytest.mark.parametrize(
    "bad", ['<a title="x' * 20_000, "<!" * 50_000, "<div>" * 20_000 + "</section>" * 20_000, "<a b='" * 20_000, "<div>x" * 20_000, "<p " * 50_000]
)
def test_broken_pages_take_little_time(bad):
    import time

    start = time.perf_counter()
    html_text.lines_of(bad)
    assert time.perf_counter() - start < 2
    assert html_text.lines_of("<p title=don't>Hello")[0][1] == "Hello"



def test_shared_lines_go_without_an_article(spark):
    a = "<html><body><div>Site banner line</div><p>first own</p><p>second own</p><div>Imprint</div></body></html>"
    b = "<html><body><div>Site banner line</div><p>quite another</p><div>Imprint</div></body></html>"
    df = spark.createDataFrame([(1, "http://a.com/n/1", a), (2, "http://a.com/n/2", b), (3, "http://z.org/n/2", b)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == {1: "first own\n\nsecond own", 2: "quite another", 3: "Site banner line\n\nquite another\n\nImprint"}


def test_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 18))] for _ in range(2))
        for cells in (1 << 31, 8):
            got = html_text.shared_lines(a, b, cells)
            it = iter(b)
            assert len(got) == length(a, b) and all(any(a[i] == y for y in it) for i in got)


def test_neighbours_across_partitions(spark):
    body = "<html><body><div>same</div><p>{}</p></body></html>"
    rows = [(i, f"http://h.com/p/{i:04d}", body.format(f"own {i}")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for size in (8 << 20, 300, 1):
        assert {r.text for r in html_text.extract_text(df, bucket_chars=size).collect()} == {f"own {i}" for i in range(60)}


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""]])
def test_empty_tables_and_texts(spark, texts):
    docs = docs_of(spark, texts).withColumn("_base", F.lit("kept")).withColumn("secret_note", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    ids = list(range(len(texts)))
    scored = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in scored) == ids and all(0 <= r.score < 0.7 for r in scored)
    assert [r.spans for r in secrets.secret_digest(docs).collect()] == [""] * len(texts)
    assert "_base" in secrets.find_secrets(docs).columns
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == ids
    assert licenses.scan_licenses(docs, licenses.train(docs)).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert [(r.text, r.n_chars) for r in html_text.extract_text(pages).collect()] == [("", 0)] * len(texts)


@pytest.mark.parametrize("texts", [[], [None, ""]])
def test_pipeline_stages_of_empty_tables(spark, tmp_path, texts):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() <= len(texts), name


# pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 40)
    clean = [prose(rng, 90) for _ in range(30)]
    texts = clean + [clean[0], clean[0] + " tail", "You are a worthless clown. " + prose(rng, 60), f"{prose(rng, 40)} {item} {prose(rng, 40)}", prose(rng, 60) + " token=abcdef123456"]
    docs_of(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] + [(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    prints = [plain_fingerprint(t) for t in texts]
    near = {31} if (prints[31] ^ prints[0]).bit_count() <= 4 else set()
    assert not {30, 32, 33} & set(out) and set(out) >= set(range(30)) - {1}
    assert near.isdisjoint(out) and "token=" not in out[34].text and out[34].n_chars == len(out[34].text)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
