"""Language-model scores by a probabilistic suffix tree over words: contexts of variable length, kept where they tell more than their suffix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, scratch

#: Share of a count that smoothing takes from each observed next word.
DISCOUNT = 0.75
#: Half a count for every word, and for all unknown ones together.
ADDED = 0.5
MOST_BITS = 1 << 28
#: Keys of words, contexts and events stand apart in one table by these.
WORD, CONTEXT, EVENT = 0, 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Open keys that one job joins: its shuffle files go before the next one's are written.
MOST_OPEN = 100_000_000
END = xxhash.xxh64_intdigest(b"")


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of word sequences from the keys of all but their last and all but their first word."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)).view(np.int64)


class Grams:
    """Keys of the word sequences of whole texts; every text ends with an end token. Sequences lie within a text."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, texts: pa.Array, longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each length from 1 to ``longest`` the key of the sequence that ends at a token, then the tokens' places in their texts, the texts' numbers of
        tokens, and the keys of the distinct words with the word of each token among them."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        starts = lists.offsets.to_numpy()
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        for w in words:
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w)
        table = np.array([*map(self.known.__getitem__, words), END], np.uint64).view(np.int64)
        if len(self.known) > 100_000:
            self.known.clear()
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        codes = coded.indices.to_numpy()
        real = codes != (words.index(b"") if b"" in words else -1)  # spaces at either end leave empty strings
        codes, owner = codes[real], owner[real]
        which = np.full(len(codes) + len(texts), len(words), np.int64)
        which[np.arange(len(codes)) + owner] = codes  # a text's end token follows its words
        sizes = np.bincount(owner, minlength=len(texts)) + 1
        keys = [table[which]]
        for _ in range(longest - 1):
            keys.append(np.concatenate((keys[-1][:1], mix(keys[-1][:-1], keys[-1][1:]))))
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return keys, place, sizes, table, which


class Bits:
    """A bitmap of keys, two bits each: what it lacks is not among them. Tasks make it from its ``words``, since broadcasts carry plain arrays only."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    @classmethod
    def of(cls, keys: DataFrame, size: int) -> Bits:
        bits = min(MOST_BITS, max(1 << 10, 1 << (16 * size).bit_length()))
        at = [F.pmod(k, F.lit(bits)) for k in (F.col("key"), F.shiftrightunsigned("key", 32))]
        by_word = keys.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        found = by_word.agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("set")).toArrow()  # at most MOST_BITS / 64 rows
        words = np.zeros(bits // 64, np.uint64)
        words[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in (keys.view(np.uint64), keys.view(np.uint64) >> np.uint64(32)):
            at = k & np.uint64(self.bits - 1)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Head:
    """The most frequent entries of a table of keys, at most ``most``, in memory; a bitmap of the others tells which keys may be among them, none if all are held.

    Counts fall into sixteen classes an octave, and as many whole classes are held as fit. Tasks make it from its ``arrays``.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, rest: np.ndarray | None):
        self.keys, self.values, self.rest = keys, values, None if rest is None else Bits(rest)
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys.view(np.uint64) >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def arrays(table: DataFrame, value: str, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray | None], DataFrame | None]:
        """What a head is made from, and the table of the entries that it lacks, if any."""
        kind = F.floor(F.log2("n") * 16)
        size, inside, held = 0, 0, None
        for r in sorted(table.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r["kind"]):
            size += r["count"]
            if size <= most:
                inside, held = size, r["kind"]
        chosen = table if inside == size else table.limit(0) if held is None else table.where(kind >= held)
        rest = None if inside == size else table if held is None else table.where(kind < held)
        top = chosen.select("key", value).toArrow()
        order = np.argsort(top["key"].to_numpy().view(np.uint64))
        return (top["key"].to_numpy()[order], top[value].to_numpy()[order], None if rest is None else Bits.of(rest, size - inside).words), rest

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, values, unsure) for each key; what is not found has the value 0. Keys are hashes, so their leading bits lead to places of one entry or few."""
        found, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if len(self.keys):
            slot = keys.view(np.uint64) >> self.shift
            at, end = self.starts[slot].astype(np.int64), self.starts[slot + np.uint64(1)]
            left = np.flatnonzero(at < end)
            while len(left):
                here = self.keys[at[left]] == keys[left]
                found[left[here]] = True
                left = left[~here]
                at[left] += 1
                left = left[at[left] < end[left]]
            at[~found] = 0
        unsure = ~found & (self.rest is not None)
        unsure[unsure] = self.rest.has(keys[unsure]) if unsure.any() else False
        return found, np.where(found, self.values[at], 0) if len(self.keys) else np.zeros(len(keys)), unsure


@dataclass
class Tree:
    """``words`` (key, n): the training words; ``contexts`` (key, b, n): log10 of what a kept context leaves to its suffix; ``events`` (key, more, n): sequences
    whose context is kept, with what the log10 of their probability is more than that of the suffix's sequence and the context's b. ``total`` tokens, ``distinct`` words; contexts of up to ``depth`` words.

    The suffix of a kept context is kept and that of an event is one, so a token's score is its word's plus the b and the more of all its contexts and events, each
    of which can be looked up by itself."""

    words: DataFrame
    events: DataFrame
    contexts: DataFrame
    total: int
    distinct: int
    depth: int

    @property
    def norm(self) -> float:
        return self.total + ADDED * (self.distinct + 1)


def _counts(texts: DataFrame, length: int, shared) -> DataFrame:
    """(ctx, low, n) of word sequences of ``length``: the keys of all but the last and of all but the first word; at length 1 ctx is 0 and low the word.

    Only sequences whose ctx and low the two bitmaps of the broadcast ``shared`` may hold are counted; each task sums them up over many texts, and no more before the shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made, held = [Bits(w) for w in shared.value] if shared else [], Grams(), []

        def out() -> pa.RecordBatch:
            pairs, n = np.concatenate([p for p, _ in held]), np.concatenate([m for _, m in held])
            order = np.argsort(mix(pairs[:, 0].copy(), pairs[:, 1].copy()))  # equal pairs stand together; any that don't are summed up later
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))) if len(pairs) else np.empty(0, np.int64)
            n = np.add.reduceat(n, first) if len(first) else n
            return pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(n)], ["ctx", "low", "n"])

        for batch in batches:
            keys, place, _, table, which = made.of(batch.column(0), max(1, length - 1))
            if length == 1:
                n = np.bincount(which, minlength=len(table))
                table, n = table[n > 0], n[n > 0]
                held.append((np.stack((np.zeros_like(table), table), 1), n))
            else:
                at = np.flatnonzero(place >= length - 1)
                at = at[known[0].has(keys[-1][at - 1])]
                at = at[known[1].has(keys[-1][at])]
                held.append((np.stack((keys[-1][at - 1], keys[-1][at]), 1), np.ones(len(at), np.int64)))
            if sum(len(n) for _, n in held) > 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(work, "ctx long, low long, n long").repartition("ctx", "low").groupBy("ctx", "low").agg(F.sum("n").alias("n"))


def _with_key(counts: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mix(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["ctx", "low", "n", "key"])

    return counts.select("ctx", "low", "n").mapInArrow(work, "ctx long, low long, n long, key long")


def grow(docs: DataFrame, text_col: str = "text", depth: int = 2, least_context: int = 32, least_event: int = 4, strength: float = 1.0) -> Tree:
    """The suffix tree of whole texts, grown by the length of its contexts.

    A context is a word sequence within a text that occurs ``least_context`` times or more. It is kept if its suffix is kept and its next words
    diverge from the suffix's: the log-likelihood gained by its own frequencies over the suffix's probabilities, its next words of fewer than ``least_event``
    occurrences taken as one, is at least ``strength`` times the logarithm of the number of training tokens. A kept context gives its other next words
    their frequency less ``DISCOUNT``, and spreads what that leaves by its suffix's distribution. The empty context adds ``ADDED`` to each
    word's count and to that of unknown words. So every context's distribution sums up to one.

    All counts are over all rows. Null text is an empty one; no rows give a tree of nothing. The tree's tables stay, or go with the ``scratch`` block around.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    words = cut(_counts(texts, 1, None).select(F.col("low").alias("key"), "n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = Tree(words, words.limit(0).select("key", F.lit(0.0).alias("more"), "n"), words.limit(0).select("key", F.lit(0.0).alias("b"), "n"), total, distinct, depth)
    end = np.uint64(END).view(np.int64).item()
    grams, lower = words, words.select("key", (F.log10((F.col("n") + ADDED) / F.lit(tree.norm))).alias("p"), "n")
    for length in range(1, depth + 1):
        may_be = grams.where((F.col("n") >= least_context) & (F.col("key") != end))
        # the longest contexts need no counts for longer ones, so only sequences whose suffix is in the tree
        needed = (lower if length == depth else grams).where(F.col("n") >= least_event)
        sizes = may_be.count(), needed.count()
        if not all(sizes):
            break
        shared = docs.sparkSession.sparkContext.broadcast((Bits.of(may_be, sizes[0]).words, Bits.of(needed, sizes[1]).words))
        with scratch(docs.sparkSession):
            grams = cut(_with_key(_counts(texts, length + 1, shared).where(F.col("n") >= least_event)), keep=True)
            shared.destroy()
            of = may_be.select(F.col("key").alias("ctx"), F.col("n").alias("n_ctx"))
            told = cut(grams.join(lower.select(F.col("key").alias("low"), F.pow(F.lit(10.0), "p").alias("p_low")), "low").join(of, "ctx"))
            gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("n_ctx") / F.col("p_low")))
            rest = F.first("n_ctx") - F.sum("n")
            rest_gain = F.when(rest > 0, rest * F.log(rest / F.first("n_ctx") / F.greatest(1 - F.sum("p_low"), F.lit(1e-12)))).otherwise(0.0)
            left = (rest + DISCOUNT * F.count("*")) / F.first("n_ctx")
            tested = told.groupBy("ctx").agg((gain + rest_gain).alias("gain"), left.alias("left"), F.first("n_ctx").alias("n_ctx"))
            kept = cut(tested.where(F.col("gain") >= strength * math.log(max(total, 2))).select("ctx", "left", "n_ctx"), keep=True)
            by_suffix = F.col("left") * F.col("p_low")
            p = (F.col("n") - DISCOUNT) / F.col("n_ctx") + by_suffix
            lower = cut(told.drop("n_ctx").join(kept, "ctx").select("key", F.log10(p).alias("p"), (F.log10(p) - F.log10(by_suffix)).alias("more"), "n"), keep=True)
        tree.events = tree.events.unionByName(lower.select("key", "more", "n"))
        tree.contexts = tree.contexts.unionByName(kept.select(F.col("ctx").alias("key"), F.log10("left").alias("b"), F.col("n_ctx").alias("n")))
    return tree


def score(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", most: int = 4_000_000) -> DataFrame:
    """(id, n_tokens, n_known, base, score) for every whole text: log10 probabilities of its tokens by the empty context alone, and by the tree.

    A token's state is the longest kept suffix of the words before it in its text. Tasks hold the ``most`` most frequent events, and a quarter as many words and contexts, and bitmaps of the
    others; a key that may be among those is left open, and is looked up in the tree's tables. Every row of ``docs`` comes back once; null text is empty, ids may be null or repeat.
    """
    spark, depth = docs.sparkSession, tree.depth
    norm, unknown = tree.norm, math.log10(ADDED / tree.norm)
    with scratch(spark):
        parts = (tree.words, "n", most // 4), (tree.events, "more", most), (tree.contexts, "b", most // 4)
        heads, (rare_words, rare_events, rare_contexts) = zip(*[Head.arrays(*part) for part in parts])
        shared = spark.sparkContext.broadcast(heads)
        slim = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, events, contexts = (Head(*arrays) for arrays in shared.value)
            made = Grams()
            for batch in batches:
                keys, place, sizes, table, which = made.of(batch.column(0), depth + 1)
                known, n, rare = words.find(table)
                of_words = contexts.find(table)
                alone = np.where(known, np.log10((n + ADDED) / norm), unknown)[which]
                more, opened = np.zeros(len(place)), []  # what contexts and events add; tokens with the keys that they leave open
                at, shorter = np.arange(len(place)), np.ones(len(place), bool)  # tokens whose context is or may be kept, whose event of a word less is or may be one

                def leave(tokens: np.ndarray, key: np.ndarray, kind: int) -> None:
                    opened.append((tokens, key ^ np.int64(kind)))

                rare = np.flatnonzero(rare[which])
                leave(rare, keys[0][rare], WORD)
                for k in range(1, depth + 1):
                    at = at[place[at] >= k]
                    kept, b, maybe = contexts.find(keys[k - 1][at - 1]) if k > 1 else (x[which[at - 1]] for x in of_words)
                    more[at] += b
                    leave(at[maybe], keys[k - 1][at[maybe] - 1], CONTEXT)
                    at = at[kept | maybe]
                    asked = at[shorter[at]]
                    seen, p, maybe = events.find(keys[k][asked])
                    more[asked] += p
                    leave(asked[maybe], keys[k][asked[maybe]], EVENT)
                    shorter[:] = False
                    shorter[asked[seen | maybe]] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = lambda x: np.bincount(owner, x, len(sizes))
                tokens, open_keys = (np.concatenate(x) for x in zip(*opened))
                by = owner[tokens]
                starts = np.concatenate(([0], np.cumsum(np.bincount(by, minlength=len(sizes))))).astype(np.int32)
                open_lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(open_keys[np.argsort(by, kind="stable")]))
                columns = map(pa.array, (sizes, sums(known[which]).astype(np.int64), sums(alone), sums(alone + more)))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns, open_lists], ["row", "id", "n_tokens", "n_known", "base", "score", "open"])

        kind = slim.schema["id"].dataType.simpleString()
        told = cut(slim.mapInArrow(work, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, open array<long>"), keep=True)
        shared.destroy()
        asked = told.agg(F.sum(F.size("open"))).first()[0]
        if not asked:
            return told.drop("row", "open")
        of_word = F.log10((F.col("n") + ADDED) / F.lit(norm)) - F.lit(unknown)
        tables = [
            rows.select(F.col("key").bitwiseXOR(F.lit(kind)).alias("key"), value.alias("value"), F.lit(kind == WORD).alias("word"))
            for rows, value, kind in ((rare_words, of_word, WORD), (rare_contexts, F.col("b"), CONTEXT), (rare_events, F.col("more"), EVENT))
            if rows is not None
        ]
        rest = cut(_looked_up(told, reduce(DataFrame.unionByName, tables), asked), keep=True)
    more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    return told.join(rest, "row", "left").select("id", "n_tokens", more("n_known"), more("base"), more("score"))


def _looked_up(told: DataFrame, table: DataFrame, asked: int) -> DataFrame:
    """What the open keys of each row that stand in ``table`` add. Keys go slice by slice, so that the shuffle files on disk at a time don't grow with their number ``asked``."""
    slices = -(-asked // MOST_OPEN)
    of_slice = lambda rows, i: rows.where(F.pmod(F.shiftrightunsigned("key", 17), F.lit(slices)) == i) if slices > 1 else rows
    keys = told.where(F.size("open") > 0).select("row", F.explode("open").alias("key"))
    value = F.when(F.col("word"), F.col("value")).otherwise(0.0)
    sums = F.count_if("word").alias("more_n_known"), F.sum(value).alias("more_base"), F.sum("value").alias("more_score")
    found = [of_slice(keys, i).join(of_slice(table, i).hint("shuffle_hash"), "key").groupBy("row").agg(*sums) for i in range(slices)]
    if slices == 1:
        return found[0]
    return reduce(DataFrame.unionByName, [cut(rows) for rows in found]).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more_n_known", "more_base", "more_score")])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, least_context: int = 32, least_event: int = 4, strength: float = 1.0, most: int = 4_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, by a tree of the texts that are not held out.

    Held out are rows whose crc32(id as text) mod 5 is 1; a null id is not. See ``grow`` and ``score`` for nulls, repeats and empty tables. Other columns are not read.
    """
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 1, F.lit(False))
    with scratch(docs.sparkSession):
        slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        tree = grow(slim.where(~held_out("id")), "text", depth, least_context, least_event, strength)
        scored = score(slim, tree, "id", "text", most)
        return cut(
            scored.select(
                F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
            ),
            keep=True,
        )
