"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import add_key, components, cut, forest, keep_rows, scratch

#: Two fingerprints at ``bits`` differing bits agree in at least ``8 - bits`` of their 8 bytes.
BYTES = 8
MAX_BITS = 4


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of UTF-8 ``text``, in order; no words: none; fewer words than ``width``: one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n], ends[min(width, len(words)) - 1 :])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes; zero for none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64
        )
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of UTF-8 ``text``; no words: zero; fewer words than ``width``: one shingle."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text; null text counts as empty."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return slim.mapInArrow(work, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def byte_masks(matches: int) -> list[int]:
    """Signed masks of every choice of ``matches`` of the 8 byte positions, in the order of the choices."""
    return [
        sum(0xFF << (8 * p) for p in chosen) - (1 << 64 if BYTES - 1 in chosen else 0)
        for chosen in combinations(range(BYTES), matches)
    ]


def first_choices(matches: int) -> np.ndarray:
    """By the set of equal byte positions (a bit each): the first choice of ``matches`` positions among them; -1 where they are fewer."""
    choices = {frozenset(x): i for i, x in enumerate(combinations(range(BYTES), matches))}
    out = np.full(256, -1, np.int64)
    for equal in range(256):
        at = [p for p in range(BYTES) if equal >> p & 1]
        if len(at) >= matches:
            out[equal] = choices[frozenset(at[:matches])]
    return out


class Tally:
    """Tallies the positional bytes that pairs share, retains those that reach the guaranteed minimum, and verifies their bits."""

    def __init__(self, bits: int):
        self.bits, self.least = bits, BYTES - bits
        self.masks = np.array(byte_masks(self.least), np.int64)
        self.first = first_choices(self.least)

    def retained(self, choice, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs share ``least`` bytes or more, meet first at ``choice`` and differ in no more than ``bits`` bits."""
        differing = (x ^ y).view(np.uint64)
        equal = np.packbits(differing.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
        tally = np.bitwise_count(equal)
        return (tally >= self.least) & (self.first[equal] == choice) & (np.bitwise_count(differing) <= self.bits)


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: each member with the smallest member it reaches."""
    a, b = (np.concatenate([p[i] for p in pairs] or [np.empty(0, np.int64)]) for i in (0, 1))
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = forest(len(nodes), places[: len(a)], places[len(a) :])
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def near_pairs(distinct: DataFrame, bits: int = MAX_BITS, wide: int = 8192) -> DataFrame:
    """Links (a, b) among distinct ``fp`` that keep every connection at ``bits`` or fewer differing bits.

    The inverted index maps (byte positions, byte values) to fingerprints, for every choice of
    the ``8 - bits`` positions that a pair is guaranteed to share. A pair that tallies ``t >= 8 - bits``
    equal positional bytes meets once for every such choice among its ``t``; it is taken at
    the first choice only and verified there by its differing bits. So posting lists of single bytes,
    whose pairs grow with the square of the corpus, are only ever read intersected.

    A list of over ``wide`` fingerprints is dealt by salts: every pair of salts is a task's group of bounded size, tallied in the same
    way. Tasks return spanning forests of the links they find, never all pairs of a list.
    """
    spark = distinct.sparkSession
    tally = Tally(bits)
    as_array = F.array(*[F.lit(int(m)) for m in tally.masks])
    index = distinct.select(F.posexplode(F.transform(as_array, lambda m: m.bitwiseAND(F.col("fp")))).alias("c", "key"), "fp")
    listed = index.repartition("c", "key").sortWithinPartitions("c", "key").select("c", "key", "fp")

    def batch(a: np.ndarray, b: np.ndarray, c: np.ndarray | None) -> pa.RecordBatch:
        choice = pa.array(c if c is not None else np.full(len(a), -1, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), choice], ["a", "b", "c"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the lists that fit, as (a, b, -1), and the postings of wide ones, as (fingerprint, key, choice)."""
        none = np.empty(0, np.int64)
        held_c, held_key, held_fp, flowing = none, none, none, None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def lists(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1]), [True])))
            size = np.diff(edge)
            too_wide = (size > wide) | np.fromiter(((c[s], key[s]) == flowing for s in edge[:-1]), bool, len(size))
            for s, n in zip(edge[:-1][too_wide], size[too_wide]):
                yield batch(fp[s : s + n], key[s : s + n], c[s : s + n])
            size = np.where(too_wide, 0, size)
            for shift in range(1, int(size.max(initial=0))):
                keep = size > shift
                s, n = edge[:-1][keep], size[keep] - shift
                x = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                ok = tally.retained(c[x], fp[x], fp[x + shift])
                if ok.any():
                    waiting.append((fp[x[ok]], fp[x[ok] + shift]))
            if sum(len(w[0]) for w in waiting) > 500_000:
                yield batch(*spanning(waiting), None)
                waiting.clear()

        for got in batches:
            c, key, fp = (np.concatenate((h, got.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, h in enumerate((held_c, held_key, held_fp)))
            last = (c[-1], key[-1])
            start = len(c) - int(np.argmax(np.append((c[::-1] != last[0]) | (key[::-1] != last[1]), True)))
            if start:
                yield from lists(c[:start], key[:start], fp[:start])
                flowing = flowing if flowing == last else None
            held_c, held_key, held_fp = c[start:], key[start:], fp[start:]
            if len(held_c) > wide or len(held_c) and flowing == last:  # an open list that is wide already flows on
                flowing = last
                yield from lists(held_c, held_key, held_fp)
                held_c, held_key, held_fp = none, none, none
        if len(held_c):
            yield from lists(held_c, held_key, held_fp)
        if waiting:
            yield batch(*spanning(waiting), None)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        choice, s1, s2 = key[0], key[2], key[3]
        fp, salt = pdf["fp"].to_numpy(), pdf["salt"].to_numpy()
        x, y = (fp, fp) if s1 == s2 else (fp[salt == s1], fp[salt == s2])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for at in range(len(x)):
            rest = y[at + 1 :] if s1 == s2 else y
            near = rest[tally.retained(choice, x[at : at + 1], rest)]
            if len(near):
                found.append((np.full(len(near), x[at]), near))
                count += len(near)
            if count > 500_000:
                found = [spanning(found)]
                count = 0
        a, b = spanning(found)
        return pd.DataFrame({"a": a, "b": b})

    with scratch(spark):
        found = cut(listed.mapInArrow(read, "a long, b long, c long"))
        links = found.where("c < 0").select("a", "b")
        postings = found.where("c >= 0").select("c", F.col("b").alias("key"), F.col("a").alias("fp"))
        salts = postings.groupBy("c", "key").agg(F.ceil(F.count("*") * 2 / F.lit(wide)).cast("int").alias("salts"))
        dealt = (
            postings.join(salts, ["c", "key"])
            .withColumn("salt", F.pmod(F.xxhash64("fp"), "salts").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .select("c", "key", F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "salt", "fp")
        )
        return cut(links.union(dealt.groupBy("c", "key", "s1", "s2").applyInPandas(join, "a long, b long")), keep=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = MAX_BITS, wide: int = 8192
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of ``bits`` or fewer differing bits.

    Empty and null texts have fingerprint zero and are linked like any other. Repeated rows come
    back as often as they came; an id of several texts is a row of each, and it joins them in one component. Rows of null id get the component of their
    fingerprint's other rows, null where there are none. An empty table gives an empty result; other columns are not read.
    """
    with scratch(docs.sparkSession):
        prints = cut(fingerprints(docs, id_col, text_col, width), keep=True)
        by_fp = cut(_components_by_fingerprint(prints, bits, wide, join_ids=True), keep=True)
    return prints.join(by_fp, "fp").select("id", "fp", "component")


def _components_by_fingerprint(prints: DataFrame, bits: int, wide: int, join_ids: bool) -> DataFrame:
    """(fp, group, component) over links of fingerprints, and (``join_ids``) over fingerprints that stand at one id; component is the smallest id."""
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = near_pairs(reps.select("fp"), bits, wide)
    if join_ids:
        least = prints.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most")
        links = links.union(prints.join(least, "id").where("fp <> a").select("a", F.col("fp").alias("b")))
    grouped = components(links)
    joined = reps.join(grouped, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    smallest = joined.groupBy("group").agg(F.min("rep").alias("component"))
    return joined.join(smallest, "group").select("fp", "group", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = MAX_BITS, wide: int = 8192) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the smallest id; rows of null id stay. See ``keep_rows`` for ids that repeat."""
    with scratch(docs.sparkSession):
        prints = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width))
        by_fp = _components_by_fingerprint(prints, bits, wide, join_ids=False)
        named = cut(prints.join(by_fp.select("fp", "group"), "fp").select("id", F.col("fp").alias("key"), F.col("group").alias("component")), keep=True)
    return keep_rows(docs, id_col, text_col, named, lambda rows: add_key(rows, lambda t: int(np.uint64(fingerprint(t, width)).view(np.int64)), "long"))
