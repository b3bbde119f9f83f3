"""Chunking, vector retrieval, tagging and masking as column expressions and joins."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _marked_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that decompose into a letter and marks, and those letters.

    A letter that is no base with marks, such as the crossed d, has no decomposition and stays.
    """
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(letter) == len(base) == 1 and base != letter:
            found[letter] = base
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _marked_letters()
#: Marks that stand as characters of their own.
LOOSE_MARKS = r"[\x{0300}-\x{036F}]"


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<string> of the chunks of a text.

    A line that begins with ``#`` (after spaces) opens a section. A section of at most ``size`` characters is a
    chunk; a longer one is cut every ``size - overlap`` characters into pieces of ``size``. Blank pieces are left out.
    """
    marked = F.regexp_replace(text, r"(?m)^(?=[ \t]*#)", "\u0001")
    sections = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(size - overlap))
        pieces = F.transform(starts, lambda a: F.substring(s, a + 1, F.lit(size)))
        return F.when(F.length(s) <= size, F.array(s)).otherwise(F.filter(pieces, lambda p: F.trim(p) != ""))

    return F.flatten(F.transform(sections, cut))


def chunk_table(docs: DataFrame, source: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(source, chunk_index, total_chunks, text): one row for each chunk; null and blank texts have none."""
    made = docs.select(F.col(source).alias("source"), chunks(F.col(text), size, overlap).alias("c"))
    return made.select("source", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; zero where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


def units(vectors: list, width: int) -> np.ndarray:
    """Rows of length one; all zeros for a vector that is null, zero, of another width, or holds null or non-finite components."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            row = np.array(v, np.float64)
            norm = np.sqrt(row @ row)
            if 0 < norm < np.inf:
                out[i] = row / norm
    return out


class Search:
    """The best ``fetch`` of the vectors shown so far for each query of a block, exact.

    Vectors are grouped by their nearest pivot. By the triangle inequality of angles, none of a group is nearer to a query than the query's
    angle to the pivot leaves to the group's nearest and farthest angle; groups that cannot reach the ``fetch``-th best so far are skipped for that
    query. The pivots are vectors of the table themselves, so their own scores bound the best from the start.
    """

    SLACK = 2e-6  # scores are compared after rounding to six places
    PAIRS = 500_000  # scored at once
    WAITING = 500_000  # hits that wait to be ranked

    def __init__(self, queries: np.ndarray, pivots: np.ndarray, fetch: int):
        self.queries, self.pivots, self.fetch = queries, pivots, fetch
        self.angles = queries @ pivots.T
        self.least = np.full(len(queries), -np.inf)
        if len(pivots) >= fetch:
            for part in self._parts(len(queries), len(pivots)):
                self.least[part] = np.partition(self.angles[part], -fetch, 1)[:, -fetch] - self.SLACK
        np.arccos(np.clip(self.angles, -1, 1, out=self.angles), out=self.angles)
        self.no_length = ~queries.any(1)
        self.pairs = self.skipped = self.held = 0
        self.best, self.waiting = None, []

    def _parts(self, n: int, width: int) -> Iterator[slice]:
        step = max(1, self.PAIRS // max(1, width))
        return (slice(at, at + step) for at in range(0, n, step))

    def show(self, vec_ids: np.ndarray, sources: np.ndarray, vectors: np.ndarray) -> None:
        to_pivots = vectors @ self.pivots.T if len(self.pivots) else np.zeros((len(vectors), 1))
        group = np.where(vectors.any(1), to_pivots.argmax(1), -1)
        for g in np.unique(group):
            of_group = np.flatnonzero(group == g)
            asked = np.arange(len(self.queries))
            if g >= 0 and len(self.pivots):
                away = np.arccos(np.clip(to_pivots[of_group, g], -1, 1))
                gap = np.maximum(0, np.maximum(self.angles[:, g] - away.max(), away.min() - self.angles[:, g]))
                asked = np.flatnonzero((np.cos(gap) >= self.least) | self.no_length)
            self.pairs += len(of_group) * len(self.queries)
            self.skipped += len(of_group) * (len(self.queries) - len(asked))
            for few in self._parts(len(of_group), 1000):
                rows = of_group[few]
                for part in self._parts(len(asked), len(rows)):
                    self._score(asked[part], rows, vec_ids, sources, vectors)

    def _score(self, asked: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, sources: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[asked] @ vectors[rows].T
        q, r = np.nonzero(scores >= self.least[asked, None])
        if len(q):
            self.waiting.append(pd.DataFrame({"q": asked[q], "score": np.round(scores[q, r], 6) + 0.0, "vec_id": vec_ids[rows[r]], "source": sources[rows[r]]}))
            self.held += len(q)
            if self.held > self.WAITING:
                self.settle()

    def settle(self) -> pd.DataFrame | None:
        """The best so far, once what waits is ranked among it."""
        if self.waiting:
            both = pd.concat([*([] if self.best is None else [self.best]), *self.waiting], ignore_index=True)
            self.waiting, self.held = [], 0
            both = both.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], ignore_index=True)
            self.best = both[both.groupby("q").cumcount() < self.fetch]
            full = self.best.groupby("q")["score"].agg(["min", "size"])
            full = full[full["size"] == self.fetch]
            self.least[full.index] = np.maximum(self.least[full.index], full["min"] - self.SLACK)
        return self.best


def top_hits(vectors: DataFrame, queries: DataFrame, k: int = 4, fetch: int | None = None, block: int = 20_000, pivots: int = 128) -> DataFrame:
    """The best ``k`` sources of each query: the best hit of a source among the ``fetch`` nearest vectors counts.

    ``queries`` (query, qv) is a stated set, dealt by hash into blocks of about ``block``: one block at a time is held by the driver and the tasks, and searched
    for in one pass over ``vectors`` (vec_id, source, v). Each task keeps the ``fetch`` nearest of a query, so what is shuffled is queries times tasks
    times ``fetch`` rows. A task scores few pairs at once and ranks hits as they come, so it holds a block and its hits however many vectors it sees. Pairs are skipped by the bounds of ``Search`` from ``pivots`` vectors of the table. Vectors without a direction (see ``units``) score zero.
    """
    spark, fetch = vectors.sparkSession, fetch or max(5 * k, 20)
    best = [F.desc("score"), F.col("vec_id")]
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *queries.schema)}
    schema = f"query {kinds['query']}, vec_id {kinds['vec_id']}, source {kinds['source']}, score double"
    sample = vectors.where("v IS NOT NULL").orderBy(F.xxhash64("vec_id")).limit(pivots).select("v").toPandas()["v"].tolist()
    width = len(sample[0]) if sample else 0
    middle = units(sample, width)
    middle = middle[middle.any(1)]
    blocks = max(1, -(-queries.count() // block))

    def found(at: int) -> DataFrame:
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == at).select("query", "qv").toPandas()
        shared = spark.sparkContext.broadcast((asked["query"].to_numpy(), units(asked["qv"].tolist(), width), middle))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, of, near = shared.value
            search = Search(of, near, fetch)
            for batch in batches:
                search.show(batch["vec_id"].to_numpy(), batch["source"].to_numpy(), units(batch["v"].tolist(), width))
            kept = search.settle()
            if kept is not None:
                yield pd.DataFrame({"query": names[kept["q"]], "vec_id": kept["vec_id"].to_numpy(), "source": kept["source"].to_numpy(), "score": kept["score"].to_numpy()})

        return vectors.select("vec_id", "source", "v").mapInPandas(work, schema)

    local = reduce(DataFrame.unionAll, map(found, range(blocks)))
    near = local.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*best))).where(F.col("n") <= fetch)
    first = near.withColumn("s", F.row_number().over(W.partitionBy("query", "source").orderBy(*best))).where("s = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k).drop("n", "s")


def label_scores(vectors: DataFrame, centroids: DataFrame, nearest: bool = False, block: int = 4096) -> DataFrame:
    """(vec_id, label, score): the cosine of each vector with every labelled centroid, or with the nearest one of a block alone.

    ``centroids`` (label, c) are dealt by hash into blocks of about ``block``; the driver and the tasks hold one block at a time, and ``vectors`` (vec_id, v) are
    read once a block where they lie. Vectors and centroids without a direction (see ``units``) score zero; ties go to the smallest label.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *centroids.schema)}
    blocks = max(1, -(-centroids.count() // block))

    def told(at: int) -> DataFrame:
        held = centroids.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == at).select("label", "c").orderBy("label").toPandas()
        width = max((len(c) for c in held["c"] if c is not None), default=0)
        shared = vectors.sparkSession.sparkContext.broadcast((held["label"].to_numpy(), units(held["c"].tolist(), width), width))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            labels, of, wide = shared.value
            for batch in batches:
                ids, scores = batch["vec_id"].to_numpy(), np.round(units(batch["v"].tolist(), wide) @ of.T, 6) + 0.0
                if not len(labels):
                    continue
                if nearest:
                    best = scores.argmax(1)  # the first of equal ones, and labels are in order
                    yield pd.DataFrame({"vec_id": ids, "label": labels[best], "score": scores[np.arange(len(ids)), best]})
                else:
                    yield pd.DataFrame({"vec_id": np.repeat(ids, len(labels)), "label": np.tile(labels, len(ids)), "score": scores.ravel()})

        return vectors.select("vec_id", "v").mapInPandas(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, score double")

    return reduce(DataFrame.unionAll, map(told, range(blocks)))


def nearest_label(vectors: DataFrame, centroids: DataFrame, threshold: float = 0.3, block: int = 4096) -> DataFrame:
    """(vec_id, score, label): each vector's nearest labelled centroid; the label is null under the threshold. Ties go to the smallest label."""
    told = label_scores(vectors, centroids, True, block)
    order = W.partitionBy("vec_id").orderBy(F.desc("score"), "label")
    first = told.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("vec_id", "score", F.when(F.col("score") >= threshold, F.col("label")).alias("label"))


def tags(text: Column, words: dict[str, list[str]]) -> Column:
    """map of tag type to the words of its list that the lower-cased text holds."""
    low = F.lower(text)
    found = [F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)) for ws in words.values()]
    return F.map_from_arrays(F.array(*[F.lit(k) for k in words]), F.array(*found))


def fold(text: Column) -> Column:
    """Lower case without combining marks, on letters of the Latin blocks or loose."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), LOOSE_MARKS, "")


def mask_literals(sql: Column) -> Column:
    """Quoted strings and numbers of a query text replaced by ``?``."""
    return F.regexp_replace(F.regexp_replace(sql, r"'[^']*'", "?"), r"\b\d+(?:\.\d+)?\b", "?")
