"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import cut, scratch

#: Masks of six tokens. Enumeration shows (the tests repeat it) that every overlap of 13 agreeing tokens at 80 % agreement holds a place where
#: one of them meets agreeing tokens only. An overlap with no smaller one inside has 13 agreeing tokens and up to 3 others, or 16, 20 or 24 and a
#: quarter of that: of 26 or more, one of two parts of 13 would reach 80 % alone.
SEEDS = ("1101111", "110010001011", "11010111")
WORD = regex.compile(r"\w+")
#: The kind of a row of the seed table that holds a single token; other rows hold the number of their mask.
TOKEN = -1


class TokenHashes(dict):
    """Hash of a token, remembered; forgets all when it holds ``most``."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) >> 1
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter((self[w] for w in words), np.int64, len(words))


@dataclass
class Rule:
    """Masks and bounds. An overlap needs ``overlap`` agreeing tokens, or a ``share`` of a shorter item, and that share of agreement.

    An item that needs fewer than ``overlap`` agreeing tokens is hashed under a run that its overlap cannot avoid: ``need`` agreeing tokens,
    parted by the ones that may differ, leave one run of ``need / (differing + 1)``.
    """

    seeds: tuple[str, ...]
    overlap: int
    share: float
    least: int
    runs: tuple[int, ...] = ()

    def __post_init__(self):
        exact = Fraction(self.share).limit_denominator(10_000)
        self.top, self.under = exact.numerator, exact.denominator
        self.masks = [np.flatnonzero([c == "1" for c in s]) for s in self.seeds] + [np.arange(n) for n in self.runs]
        self.spans = [len(s) for s in self.seeds] + list(self.runs)
        self.factors = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.int64) | 1

    def need(self, size: int) -> int:
        return min(self.overlap, -(-self.top * size // self.under))

    def run(self, size: int) -> int:
        """Length of the run of an item of ``size`` tokens; 0 where the seeds cover it."""
        if -(-self.top * size // self.under) >= self.overlap and size >= max(map(len, self.seeds)):
            return 0
        return -(-self.need(size) // (size - self.need(size) + 1))

    def hashes(self, w: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        total = np.full(len(starts), m * 0x9E3779B97F4A7 + 7, np.int64)
        for p in self.masks[m]:
            total += w[starts + p] * self.factors[p % 64]
            total ^= (total >> 29) & 0x7FFFFFFFF
        return total

    def best(self, doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
        """The segment of most agreeing tokens among those with the share at this shift: (agreeing, start, end) in the document."""
        low, high = max(0, shift), min(len(doc), shift + len(item))
        same = doc[low:high] == item[low - shift : high - shift]
        count = np.concatenate(([0], np.cumsum(same)))
        excess = np.concatenate(([0], np.cumsum(self.under * same - self.top)))
        left = np.searchsorted(-np.minimum.accumulate(excess), -excess, "left")  # the first place of no more excess
        right = int(np.argmax(count - count[left]))
        left = int(left[right])
        inside = left + np.flatnonzero(same[left:right])
        return (len(inside), low + int(inside[0]), low + int(inside[-1]) + 1) if len(inside) else (0, low, low)


def seed_table(items: DataFrame, rule: Rule) -> DataFrame:
    """(kind, hash, item, place): the masked windows of every item, and its tokens under kind ``TOKEN``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = tokens.of(text)
                if len(w) < rule.least:
                    continue
                run = rule.run(len(w))
                chosen = range(len(rule.seeds)) if run == 0 else [len(rule.seeds) + rule.runs.index(run)]
                own = np.unique(w)
                parts = [(np.full(len(own), TOKEN), own, np.zeros(len(own), np.int64))]
                for m in chosen:
                    starts = np.arange(max(0, len(w) - rule.spans[m] + 1))
                    parts.append((np.full(len(starts), m), rule.hashes(w, starts, m), starts))
                kind, hashed, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
                columns = [pa.array(kind.astype(np.int32)), pa.array(hashed), pa.array(np.full(len(kind), item)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "hash", "item", "place"])

    return items.select("item", "text").mapInArrow(work, "kind int, hash long, item long, place int")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) with the place of every hash set; its words are gathered by aggregation."""
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (64 * len(bitmap) - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def _overlaps(
    docs: DataFrame, items: DataFrame, seeds: tuple[str, ...], overlap: int, share: float, least: int, most_bits: int
) -> DataFrame:
    """Of ``docs`` (doc_id, text) and ``items`` (item_id, text): (doc_id, text, item_id, n_overlap, start, end) of the best overlaps that reach the bounds."""
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"], items.schema["item_id"]
    items = cut(items.where("length(text) > 0").distinct().withColumn("item", F.monotonically_increasing_id()))
    plain = Rule(seeds, overlap, share, least)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenHashes()
        for batch in batches:
            found = {plain.run(n) for n in map(len, map(tokens.of, batch.column(0).to_pylist())) if n >= max(1, least)}
            yield pa.RecordBatch.from_pydict({"run": pa.array(sorted(found), pa.int32())})

    runs = items.select("text").mapInArrow(sizes, "run int").where("run > 0").distinct().collect()  # lengths below ``overlap``
    rule = Rule(seeds, overlap, share, max(1, least), tuple(sorted(r[0] for r in runs)))
    table = cut(seed_table(items, rule))
    windows, words = table.where(F.col("kind") != TOKEN), table.where(F.col("kind") == TOKEN)
    size = lambda n: min(most_bits, 1 << max(12, (512 * n).bit_length()))
    seen, known = _bitmap(windows, size(windows.count())), _bitmap(words, size(words.count()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenHashes()
        for batch in batches:
            rows, kinds, hashes, places = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                w = tokens.of(text.as_py())
                if not len(w):
                    continue
                in_items = _set(known, w)
                parts = []
                for m, mask in enumerate(rule.masks):
                    n = len(w) - rule.spans[m] + 1
                    if n <= 0:
                        continue
                    ok = in_items[:n].copy()
                    for p in mask[1:]:
                        ok &= in_items[p : p + n]
                    starts = np.flatnonzero(ok)
                    if len(starts):
                        hashed = rule.hashes(w, starts, m)
                        hit = _set(seen, hashed)
                        if hit.any():
                            parts.append((np.full(hit.sum(), m, np.int32), hashed[hit], starts[hit].astype(np.int32)))
                if parts:
                    rows.append(k)
                    for to, i in ((kinds, 0), (hashes, 1), (places, 2)):
                        to.append(np.concatenate([p[i] for p in parts]))
            if rows:
                lists = [pa.array(v, pa.list_(t)) for v, t in ((kinds, pa.int32()), (hashes, pa.int64()), (places, pa.int32()))]
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, *lists], ["doc_id", "text", "kinds", "hashes", "places"])

    found = docs.select("doc_id", "text").mapInArrow(
        find, StructType([doc_type, docs.schema["text"]]).add("kinds", ArrayType(IntegerType())).add("hashes", ArrayType(LongType())).add("places", ArrayType(IntegerType()))
    )
    hits = cut(found.withColumn("row", F.monotonically_increasing_id()))
    windows_of = hits.select("row", F.explode(F.arrays_zip("kinds", "hashes", "places")).alias("h")).select(
        "row", F.col("h.kinds").alias("kind"), F.col("h.hashes").alias("hash"), F.col("h.places").alias("at")
    )
    lines = windows_of.join(windows, ["kind", "hash"]).groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    both = lines.join(items.withColumnRenamed("text", "item_text"), "item").join(hits.select("row", "doc_id", "text"), "row")
    out = StructType([StructField("doc_id", doc_type.dataType), docs.schema["text"], StructField("item_id", item_type.dataType)])
    for name in ("n_overlap", "start", "end"):
        out = out.add(name, IntegerType())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenHashes()
        for batch in batches:
            rows, best = [], []
            for k, (text, item, shifts) in enumerate(zip(*(batch.column(c) for c in ("text", "item_text", "shifts")))):
                w, i = tokens.of(text.as_py()), tokens.of(item.as_py())
                top = max(rule.best(w, i, shift) for shift in shifts.as_py())
                if top[0] >= rule.need(len(i)):
                    rows.append(k)
                    best.append(top)
            if rows:
                taken = batch.select(["doc_id", "text", "item_id"]).take(pa.array(rows, pa.int64()))
                numbers = [pa.array([b[i] for b in best], pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *numbers], ["doc_id", "text", "item_id", "n_overlap", "start", "end"])

    return both.select("doc_id", "text", "item_id", "item_text", "shifts").mapInArrow(verify, out)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: tuple[str, ...] = SEEDS,
    overlap: int = 13,
    share: float = 0.8,
    least: int = 8,
    most_bits: int = 1 << 27,
) -> DataFrame:
    """(doc_id, item_id, n_overlap, start, end): substitution-tolerant overlaps of documents with test items.

    Tokens are lower-cased runs of word characters, compared by 63-bit hashes. Every mask of ``seeds`` reads some positions of a token
    window and ignores the others. Documents are read once: windows whose hash may be a test window's, by a bitmap of at most ``most_bits``
    bits, leave the scan and are joined with the test windows by mask and hash. At the shift of each hit the
    segment of most agreeing tokens among those of at least ``share`` agreement is taken. A pair is returned if
    the best overlap has ``overlap`` agreeing tokens, or a ``share`` of an item that is
    shorter. The default masks miss no overlap of the default bounds; short items have runs of their own that miss none at any. ``start``
    and ``end`` are token positions in the document, end exclusive.

    Items of fewer than ``least`` tokens are not searched, since such a run of words proves nothing. Null and empty
    texts and items match nothing; an item of null id counts and is named null; of items with one id each text counts. Rows of one id, null among them, give
    one row an item, the best. Empty tables give an empty result; other columns are not read.
    """
    with scratch(docs.sparkSession):
        slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
        found = _overlaps(slim, items, seeds, overlap, share, least, most_bits)
        best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_overlap", "start", "end")).alias("best"))
        return cut(best.select("doc_id", "item_id", "best.n_overlap", "best.start", "best.end"), keep=True)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: tuple[str, ...] = SEEDS,
    overlap: int = 13,
    share: float = 0.8,
    least: int = 8,
    most_bits: int = 1 << 27,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps no test item by the rule of ``contaminated``. Texts to drop are known by two 64-bit hashes."""
    with scratch(docs.sparkSession):
        slim = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
        items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
        found = _overlaps(slim, items, seeds, overlap, share, least, most_bits)
        gone = cut(found.select(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")).distinct(), keep=True)
    text = docs[text_col]
    return docs.join(gone, (F.xxhash64(text) == gone["h1"]) & (F.xxhash64(text, F.lit(1)) == gone["h2"]), "left_anti")
