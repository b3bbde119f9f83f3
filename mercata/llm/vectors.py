"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, forest


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix, which spreads any direction's energy evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_pairs(points: np.ndarray, reach: float, chunk: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Range join within one block: pairs (i, j), each unordered pair once, of ``points`` no further apart than ``reach``.

    Points are dealt into strips of the width of the range along the first axis and sorted along the second; a chunk of a strip meets only the
    points of its own strip and the next that its range reaches. Distances are of single precision with slack, so none is missed.
    """
    x = points.astype(np.float32)
    strip = np.floor(x[:, 0] / np.float32(reach)).astype(np.int64)
    second = x[:, min(1, x.shape[1] - 1)]
    order = np.lexsort((second, strip))
    x, strip, second = x[order], strip[order], second[order]
    square = (x * x).sum(1)
    limit = np.float32(reach * reach + 1e-5)
    names, edge = np.unique(strip, return_index=True)
    edge = np.append(edge, len(x))
    slack = np.float32(reach * 1.001 + 1e-5)
    for s in range(len(names)):
        spans = [(edge[s], edge[s + 1])]
        if s + 1 < len(names) and names[s + 1] == names[s] + 1:
            spans.append((edge[s + 1], edge[s + 2]))
        for a in range(edge[s], edge[s + 1], chunk):
            b = min(a + chunk, edge[s + 1])
            for low, high in spans:
                lo = low + int(np.searchsorted(second[low:high], second[a] - slack, "left"))
                hi = low + int(np.searchsorted(second[low:high], second[b - 1] + slack, "right"))
                lo = max(lo, a) if low == edge[s] else lo
                if lo >= hi:
                    continue
                near = square[a:b, None] + (square[None, lo:hi] - 2 * (x[a:b] @ x[lo:hi].T)) <= limit
                i, j = np.nonzero(near)
                i, j = i + a, j + lo
                ok = i < j
                if ok.any():
                    yield order[i[ok]], order[j[ok]]


class Group:
    """Vectors that one task joins: unit vectors, their rotated blocks and each block's share of the squared-distance budget."""

    def __init__(self, x: np.ndarray, cosine: float, blocks: int):
        dim = x.shape[1]
        self.x, self.norm, self.cosine = x, np.linalg.norm(x, axis=1), cosine
        self.turned = (x / self.norm[:, None]) @ rotation(dim)
        self.cuts = np.array_split(np.arange(dim), min(blocks, dim))
        self.shares = np.array([(2 - 2 * cosine) * len(c) / dim for c in self.cuts]) + 1e-9

    def pairs_in(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return block_pairs(self.turned[:, self.cuts[block]], math.sqrt(self.shares[block]))

    def first_block(self, p: np.ndarray, q: np.ndarray, block: int) -> np.ndarray:
        """Whether ``block`` is the first in which the pair is under its share of the budget."""
        under = np.zeros((len(p), block + 1), bool)
        for b in range(block + 1):
            gap = self.turned[p][:, self.cuts[b]] - self.turned[q][:, self.cuts[b]]
            under[:, b] = (gap * gap).sum(1) <= self.shares[b]
        return under[:, block] & (under.argmax(1) == block)

    def linked(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The cosine test in double precision."""
        return (self.x[p] * self.x[q]).sum(1) / (self.norm[p] * self.norm[q]) >= self.cosine


def _slices(*arrays: np.ndarray, size: int = 65536) -> Iterator[tuple[np.ndarray, ...]]:
    for k in range(0, len(arrays[0]), size):
        yield tuple(a[k : k + size] for a in arrays)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    blocks: int = 8,
    cell_rows: int = 8000,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, by exact cosine >= ``cosine`` within a label.

    Method: unit vectors are rotated and split into ``blocks`` low-dimensional blocks. A linked pair has
    squared distance at most ``2 - 2 cosine``, so by the pigeonhole principle some block holds no more
    than that block's share of the budget (its share of the dimensions). Each block is range-joined under its
    share, and the union of what the blocks find is verified with the cosine in double precision.

    A label of at most ``cell_rows`` vectors is one cell, which one task joins in every block. A larger one is spread on a grid over each
    block: a vector is home to one cell and is copied to each cell that its range ball reaches, and the grid has as many axes as bring the label
    to about ``cell_rows`` vectors a cell. A cell of more rows (a tight cluster) is dealt as pairs of salts, so that no task holds over two salts of
    it. There a pair is taken at its first block under budget and in the home cell of its smaller class, so links are counted
    once. Tasks return link counts and a spanning forest, never the pairs.

    Equal vectors of one label are joined once as a class with a weight. Rows whose vector is null,
    empty, zero or has a null or non-finite component, or whose label or id is null, link with nothing;
    vectors of other lengths are compared with their own length only. Every row comes back; rows that repeat an id are vectors of their own, each with
    its own links, that stand at one node of the graph. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")
    )
    sound = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.coalesce(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    keyed = rows.select("vec_id", F.when(sound, F.col("v")).alias("v"), "label")
    # a class has a number of its own, since one id may stand at several vectors; written once, it stays
    classes = cut(
        keyed.where("v IS NOT NULL")
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    sized = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    #: Axes to grid: a cell side of three ranges leaves about three cells to an axis of the spread of unit vectors.
    axes = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / cell_rows) / math.log(3.0))).cast("int")
    placed = (
        classes.withColumn("dim", F.size("v"))
        .join(sized.select("label", "dim", axes.alias("axes")), ["label", "dim"])
        .select("label", "dim", "axes", "class", "rep", "weight", "v")
    )
    kind, id_kind = (classes.schema[c].dataType.simpleString() for c in ("label", "rep"))
    reported = f"class long, rep {id_kind}, root {id_kind}, links long"

    def report(pdf: pd.DataFrame, links: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        p, q = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
        root, keep, rep = forest(len(pdf), p, q), links > 0, pdf["rep"].to_numpy()
        return pd.DataFrame({"class": pdf["class"].to_numpy()[keep], "rep": rep[keep], "root": rep[root[keep]], "links": links[keep]})

    def join_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        group = Group(np.stack(pdf["v"].to_numpy()).astype(np.float64), cosine, blocks)
        candidate = np.zeros((len(pdf), len(pdf)), bool)  # bounded: at most cell_rows squared
        for b in range(len(group.cuts)):
            for i, j in group.pairs_in(b):
                candidate[np.minimum(i, j), np.maximum(i, j)] = True
        weight, links, found = pdf["weight"].to_numpy(), np.zeros(len(pdf), np.int64), []
        for at in range(0, len(pdf), 512):
            i, j = np.nonzero(candidate[at : at + 512])
            for p, q in _slices(i + at, j):
                ok = group.linked(p, q)
                p, q = p[ok], q[ok]
                links += np.bincount(p, weight[q], len(pdf)).astype(np.int64) + np.bincount(q, weight[p], len(pdf)).astype(np.int64)
                found.append((p, q))
        return report(pdf, links, found)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("label", "dim", "class", "rep", "weight", "v")
        for pdf in frames:
            parts = []
            for (dim, axes), part in pdf.groupby(["dim", "axes"], sort=False):
                group = Group(np.stack(part["v"].to_numpy()).astype(np.float64), cosine, blocks)
                for b, cols in enumerate(group.cuts):
                    reach = math.sqrt(group.shares[b]) + 1e-6
                    for at, cell, home in reached_cells(group.turned[:, cols[: min(axes, len(cols))]], reach):
                        rows = part.iloc[at][list(names)]
                        parts.append(rows.assign(block=b, home=home, cell=[",".join(map(str, c)) for c in cell]))
            if parts:
                yield pd.concat(parts, ignore_index=True)[["label", "dim", "block", "cell", "home", "class", "rep", "weight", "v"]]

    spread = cut(
        placed.where("axes > 0").mapInPandas(
            place, f"label {kind}, dim int, block int, cell string, home boolean, class long, rep {id_kind}, weight long, v array<double>"
        )
    )
    salts = spread.groupBy("label", "dim", "block", "cell").agg(F.ceil(F.count("*") / float(cell_rows)).cast("int").alias("salts"))
    dealt = (
        spread.join(salts, ["label", "dim", "block", "cell"])
        .withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .withColumn("s1", F.least("salt", "other"))
        .withColumn("s2", F.greatest("salt", "other"))
    )

    def join_cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, s1, s2 = key[2], key[4], key[5]
        pdf = pdf.sort_values("class", kind="stable", ignore_index=True)
        group = Group(np.stack(pdf["v"].to_numpy()).astype(np.float64), cosine, blocks)
        home, salt, weight = (pdf[c].to_numpy() for c in ("home", "salt", "weight"))
        links, found = np.zeros(len(pdf), np.int64), []
        for i, j in group.pairs_in(block):
            for p, q in _slices(np.minimum(i, j), np.maximum(i, j)):
                ok = home[p] if s1 == s2 else home[p] & (salt[p] != salt[q])
                p, q = p[ok], q[ok]
                ok = group.first_block(p, q, block)
                p, q = p[ok], q[ok]
                ok = group.linked(p, q)
                p, q = p[ok], q[ok]
                links += np.bincount(p, weight[q], len(pdf)).astype(np.int64) + np.bincount(q, weight[p], len(pdf)).astype(np.int64)
                found.append((p, q))
        return report(pdf, links, found)

    in_cells = dealt.groupBy("label", "dim", "block", "cell", "s1", "s2").applyInPandas(join_cell, reported)
    whole = placed.where("axes = 0").select("label", "dim", "class", "rep", "weight", "v").groupBy("label", "dim").applyInPandas(join_whole, reported)
    found = cut(whole.unionByName(in_cells))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "class", "left").select(
        F.col("label").alias("l"), F.col("v").alias("cv"), "class", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    named = cut(
        keyed.join(by_class, (F.col("label") == F.col("l")) & (F.col("v") == F.col("cv")), "left").select(
            "vec_id", "class", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        )
    )
    several = named.where("class IS NOT NULL").groupBy("vec_id").agg(F.count_distinct("class").alias("n")).where("n > 1").select("vec_id")
    joints = named.where("class IS NOT NULL").join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    grouped = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(joints))
    out = named.join(grouped, F.col("rep") == F.col("node"), "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def reached_cells(y: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home) of a grid with sides of three ranges: every row's own cell, and each other cell that its range ball reaches."""
    side = 3 * reach
    scaled = y / side + 0.5  # no cell wall where coordinates are densest
    low = np.floor(scaled).astype(np.int64)
    reached = [(np.arange(len(y)), low, np.zeros(len(y)))]
    for axis in range(y.shape[1]):
        more = []
        for at, cell, used in reached:
            inside = scaled[at, axis] - low[at, axis]
            for step, gap in ((-1, inside), (1, 1 - inside)):
                total = used + (gap * side) ** 2
                ok = total <= reach * reach
                if ok.any():
                    moved = cell[ok].copy()
                    moved[:, axis] += step
                    more.append((at[ok], moved, total[ok]))
        reached += more
    return [(at, cell, k == 0) for k, (at, cell, _) in enumerate(reached)]
