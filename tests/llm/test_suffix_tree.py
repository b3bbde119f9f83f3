"""Suffix-tree scores against a plain tree of tuples, and its distributions against one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mercata.llm import suffix_tree

SCHEMA = "doc_id long, text string, key string, n long"
END = "</s>"


def tokens(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [END]


class Plain:
    def __init__(self, texts, depth, least_context, least_event, strength):
        self.depth = depth
        docs = [tokens(t) for t in texts]
        self.words = Counter(w for d in docs for w in d)
        self.total = self.words.total()
        self.norm = self.total + 0.5 * (len(self.words) + 1)
        self.left, self.events = {}, {}
        grams = Counter((w,) for d in docs for w in d)
        lower = {g: self.alone(g[0]) for g in grams}
        for k in range(1, depth + 1):
            counted = Counter(tuple(d[i - k : i + 1]) for d in docs for i in range(k, len(d)))
            followers = defaultdict(dict)
            for g, n in counted.items():
                if n >= least_event and g[1:] in lower and grams[g[:-1]] >= least_context:
                    followers[g[:-1]][g[-1]] = n
            found = {}
            for ctx, next_words in followers.items():
                n_ctx = grams[ctx]
                rest = n_ctx - sum(next_words.values())
                gain = sum(n * math.log(n / n_ctx / lower[ctx[1:] + (w,)]) for w, n in next_words.items())
                if rest:
                    gain += rest * math.log(rest / n_ctx / max(1 - sum(lower[ctx[1:] + (w,)] for w in next_words), 1e-12))
                if gain >= strength * math.log(self.total):
                    self.left[ctx] = (rest + 0.75 * len(next_words)) / n_ctx
                    for w, n in next_words.items():
                        found[ctx + (w,)] = (n - 0.75) / n_ctx + self.left[ctx] * lower[ctx[1:] + (w,)]
            self.events |= found
            grams, lower = counted, found

    def alone(self, w):
        return (self.words[w] + 0.5) / self.norm

    def p(self, ctx, w):
        while ctx not in self.left:
            if not ctx:
                return self.alone(w)
            ctx = ctx[1:]
        return self.events[ctx + (w,)] if ctx + (w,) in self.events else self.left[ctx] * self.p(ctx[1:], w)

    def score(self, text):
        d = tokens(text)
        return sum(math.log10(self.p(tuple(d[max(0, i - self.depth) : i]), w)) for i, w in enumerate(d))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "ÉTÉ", "b c"]
    phrases = [rng.choices(words, k=6) for _ in range(5)]
    phrases += [f"w{a} w3 w4 w{b}".split() for a, b in ((1, 5), (9, 6), (8, 7))]  # what follows w3 w4 hangs on the word before
    out = []
    for i in range(260):
        text = []
        while len(text) < rng.randint(0, 60):
            text += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(words[: 1 + rng.randrange(len(words))])]
        out.append((i, rng.choice([" ", "\t", "  \n", "\x0b"]).join(text), "clash", i))
    out += out[:10]
    return out + [(900, None, "", 1), (901, "", "", 1), (902, " \n", "", 1), (None, "W1 w2 W3 nie-gesehen", "", 1), (903, "w1 " * 20_000, "", 1), (904, "unseen words only here", "", 1)]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("depth, most, strength", [(3, 4_000_000, 1.0), (3, 40, 0.5), (2, 4, 0.5), (1, 400, 3.0)])
def test_scores_equal_a_plain_tree(spark, depth, most, strength):
    """Also where heads hold a few entries only and tokens are joined with the tables."""
    docs = corpus(depth)
    train = [t for i, t, *_ in docs if not held_out(i)]
    plain = Plain(train, depth, 12, 2, strength)
    assert len(plain.left) > 3 and (strength > 1 or max(map(len, plain.left)) == depth)
    got = suffix_tree.lm_scores(spark.createDataFrame(docs, SCHEMA), depth=depth, least_context=12, least_event=2, strength=strength, most=most).collect()
    assert len(got) == len(docs)
    expected = sorted((i if i is not None else -1, held_out(i), len(tokens(t)), sum(plain.words[w] > 0 for w in tokens(t)), t or "") for i, t, *_ in docs)
    for r, (i, held, n, known, text) in zip(sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens)), expected):
        assert ((r.doc_id if r.doc_id is not None else -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, n, known, plain.total)
        assert r.base_score == pytest.approx(sum(math.log10(plain.alone(w)) for w in tokens(text)), rel=1e-9)
        assert r.score == pytest.approx(plain.score(text), rel=1e-9)
    total = lambda c: sum(r[c] for r in got if r.held_out and r.n_tokens < 100)
    assert total("score") > total("base_score")


def test_every_context_sums_up_to_one():
    plain = Plain([t for _, t, *_ in corpus(7)], 3, 12, 2, 0.5)
    assert len(plain.left) > 10
    for ctx in [(), *plain.left]:
        unknown = plain.p(ctx, "never seen")
        assert sum(plain.p(ctx, w) for w in plain.words) + unknown == pytest.approx(1)


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_tree.lm_scores(empty).count() == 0
    only_held_out = spark.createDataFrame([(i, "a b", "", 1) for i in range(40) if held_out(i)], SCHEMA)
    got = suffix_tree.lm_scores(only_held_out).collect()
    assert got and all((r.train_tokens, r.n_tokens, r.n_known, r.base_score, r.score) == (0, 3, 0, 0.0, 0.0) for r in got)


def test_a_whole_head_leaves_no_key_open(spark):
    """Only a bitmap of the entries that a head lacks can leave a key open."""
    table = spark.range(1, 3001).selectExpr("xxhash64(id) AS key", "3001 - id AS n", "double(id) AS v")
    held = {r.key: r.v for r in table.collect()}
    asked = np.array([*held, *np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 300_000)], np.int64)
    for most in (3000, 1000):
        arrays, rest = suffix_tree.Head.arrays(table, "v", most)
        found, values, unsure = suffix_tree.Head(*arrays).find(asked)
        others = {r.key for r in rest.collect()} if rest else set()
        assert (most == 3000) == (not others) and len(arrays[0]) + len(others) == 3000
        assert found.sum() == len(arrays[0]) and all(values[:3000][found[:3000]] == [held[k] for k in asked[:3000][found[:3000]].tolist()])
        assert unsure[:3000].sum() == len(others) and unsure.sum() <= len(others) + 30_000 * bool(others)


def test_an_open_token_costs_one_key_a_question(spark, monkeypatch):
    """Tiny heads: what is written and joined for a token is the few keys that are in doubt, in slices that bound the shuffle files, and the scores stay."""
    docs, tables, joined = corpus(2), [], []
    cut, looked_up = suffix_tree.cut, suffix_tree._looked_up
    monkeypatch.setattr(suffix_tree, "cut", lambda df, keep=False: tables.append(cut(df, keep)) or tables[-1])
    monkeypatch.setattr(suffix_tree, "_looked_up", lambda told, table, asked: joined.append((told.selectExpr("sum(n_tokens)").first()[0], asked)) or looked_up(told, table, asked))
    monkeypatch.setattr(suffix_tree, "MOST_OPEN", 20_000)
    plain = Plain([t for i, t, *_ in docs if not held_out(i)], 2, 12, 2, 0.5)
    got = {(r.doc_id, r.n_tokens): r.score for r in suffix_tree.lm_scores(spark.createDataFrame(docs, SCHEMA), depth=2, least_context=12, least_event=2, strength=0.5, most=4).collect()}
    (tokens_in_all, asked), = joined
    assert 20_000 < asked <= 5 * tokens_in_all  # a word, and two contexts and events at most
    assert sum("more_score" in t.columns for t in tables) > 2  # slices
    for i, text, *_ in docs:
        assert got[i, len(tokens(text))] == pytest.approx(plain.score(text), rel=1e-9)
