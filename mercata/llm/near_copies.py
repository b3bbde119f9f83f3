"""Near copies by the Jaccard similarity of word shingles: SimHash links first, then a prefix index that misses no pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import add_key, components, cut, keep_rows, scratch
from .simhash import MAX_BITS, majority, near_pairs, shingle_hashes

WIDTH = 5
#: Similarity as a fraction, so that its test is exact in whole numbers.
SIMILARITY = (4, 5)
#: Words of 64 bits in the small sketch that travels with postings.
SKETCH = 8


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def sketch(own: np.ndarray, size: int = 0) -> bytes:
    """Parity of the set in ``size`` bits, by default two to four a shingle. Sets differ in at least as many shingles as their sketches in bits."""
    size = size or (max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64)
    odd = np.bincount((own & (size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ at the size of the smaller: the larger is folded, since sizes are powers of two."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(slim: DataFrame, width: int, sample: int = 5000, least: int = 5, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of documents, sorted, with their counts. They only set the order of the index: no result depends on them."""
    part = slim.where(F.pmod(F.xxhash64("id"), F.lit(1 + slim.count() // sample)) == 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle_set(t or b"", width) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["set"])

    counted = part.select("text").mapInArrow(sets, "set array<long>").select(F.explode("set").alias("s")).groupBy("s").count().where(F.col("count") >= least)
    rows = sorted(tuple(r) for r in counted.orderBy(F.desc("count"), "s").limit(most).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefixes(slim: DataFrame, width: int, similarity: tuple[int, int], order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, fp, digest, n, sketch, small, prefix): SimHash, digest, size and two parity sketches of the shingle set, and its first shingles in the common order.

    With shingles in one order for all, rare ones first, two sets of a similarity of ``s`` share one of their first ``n - ceil(s n) + 1``.
    """
    keys, counts = order
    top, under = similarity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, sizes, sketches, small, firsts = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text or b"", width)
                fps.append(majority(hashes))
                own = np.unique(hashes).view(np.int64)
                digests.append(digest(own))
                n = len(own)
                rank = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[at] == own, counts[at], 0)
                sizes.append(n)
                sketches.append(sketch(own))
                small.append(sketch(own, 64 * SKETCH))
                firsts.append(own[np.lexsort((own, rank))[: n - -(-top * n // under) + 1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary()), pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["id", "fp", "digest", "n", "sketch", "small", "prefix"],
            )

    return slim.mapInArrow(work, f"id {slim.schema['id'].dataType.simpleString()}, fp long, digest binary, n int, sketch binary, small binary, prefix array<long>")


def in_lists(rows: DataFrame, order: list[str], handle, schema: str, **fixed) -> DataFrame:
    """``handle`` over the posting lists of ``rows``: runs of whole lists as arrays, a run at a time, where rows of a shingle lie together, sorted by ``order``."""
    columns = rows.columns
    listed = rows.repartition("shingle").sortWithinPartitions("shingle", *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
            table = pa.Table.from_batches(parts).combine_chunks()
            out = {}
            for c in columns:
                values = table.column(c)
                if c == "sketch":
                    out[c] = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(len(values), SKETCH)
                else:
                    out[c] = values.to_numpy().astype(np.int64)
            return out

        held: list[pa.RecordBatch] = []
        for batch in batches:
            shingles = batch.column("shingle").to_numpy()
            start = int(np.searchsorted(shingles, shingles[-1]))
            if start == 0 and (not held or held[-1].column("shingle")[-1].as_py() == shingles[0]):  # the open list goes on
                held.append(batch)
                continue
            yield from handle(arrays([*held, batch.slice(0, start)]), **fixed)
            held = [batch.slice(start)]
        if held:
            yield from handle(arrays(held), **fixed)

    return listed.mapInArrow(work, schema)


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))


def shared_only(run: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings of lists that hold several classes."""
    size = np.diff(_edges(run["shingle"]))
    keep = np.repeat(size > 1, size)
    if keep.any():
        yield pa.RecordBatch.from_pydict({c: v[keep] if c != "n" else v[keep].astype(np.int32) for c, v in run.items()})


def listed_pairs(run: dict[str, np.ndarray], top: int, under: int, hooks: bool, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a list whose sizes allow the similarity, whose sketches do not rule it out and whose components differ.

    ``hooks``: for each class only the first such partner before it, so a list yields no more pairs than it has members. Lists are compared
    where they lie, in pieces of ``most`` pairs, so only what may be similar leaves the task.
    """
    n, node, group, bits = run["n"], run["node"], run["component"], run["sketch"]
    edge = _edges(run["shingle"])
    size = np.diff(edge)

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (group[x] != group[y]) & (np.minimum(n[x], n[y]) * under >= np.maximum(n[x], n[y]) * top)
        at = np.flatnonzero(ok)
        differing = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(1, dtype=np.int64)
        ok[at] = differing * (under + top) <= (n[x[at]] + n[y[at]]) * (under - top)
        return ok

    found: list[np.ndarray] = []
    hooked = np.zeros(len(n), bool)
    for shift in range(1, int(size.max(initial=0))):
        keep = size > shift
        s, m = edge[:-1][keep], size[keep] - shift
        x = np.repeat(s - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        for k in range(0, len(x), most):
            y = x[k : k + most]
            if hooks:
                y = y[~hooked[y + shift]]
            y = y[allowed(y, y + shift)]
            if len(y):
                hooked[y + shift] = True
                found.append(np.sort(np.stack((node[y], node[y + shift]), axis=1), axis=1))
        if sum(map(len, found)) > most:
            both = np.unique(np.concatenate(found), axis=0)
            found = []
            yield pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})
    if found:
        both = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})


def candidates(shared: DataFrame, groups: DataFrame, similarity: tuple[int, int], hooks: bool) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a posting list of ``shared`` (shingle, n, node, sketch); see ``listed_pairs``."""
    top, under = similarity
    rows = shared.join(groups, "node", "left").select("shingle", "n", "node", F.coalesce("component", "node").alias("component"), "sketch")
    return in_lists(rows, ["n", "node"], listed_pairs, "a long, b long", top=top, under=under, hooks=hooks).distinct()


def plausible(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) of classes whose sketches do not differ in more bits than their sets may differ in shingles. It loses none."""
    top, under = similarity
    a, b = (classes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, sa, nb, sb = (batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb"))
            ok = [differing_bits(x, y) * (under + top) <= (m + n) * (under - top) for m, x, n, y in zip(na, sa, nb, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(work, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int], leaves: int = 64) -> DataFrame:
    """The ``pairs`` (hub, leaf) whose shingle sets have the Jaccard similarity, from ``texts`` (node, digest, text).

    A hub's text meets ``leaves`` leaves at a time, so a leaf travels once and a task holds little. A text whose set has another digest than
    its class (an id of several texts) is passed over.
    """
    top, under = similarity
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(leaves)).alias("salts"))
    salted = cut(pairs.join(sizes, "hub").select("hub", "leaf", F.pmod(F.xxhash64("leaf"), "salts").alias("salt")))
    ends = salted.union(salted.select("hub", F.col("hub").alias("leaf"), "salt").distinct())
    sent = ends.join(texts, ends["leaf"] == texts["node"]).select("hub", "salt", "leaf", "digest", "text")

    def check(table: pa.Table) -> pa.Table:
        hub = table.column("hub")[0].as_py()
        sets = {}
        for leaf, expected, text in zip(*(table.column(c) for c in ("leaf", "digest", "text"))):
            own = shingle_set(text.as_py() or b"", width)
            if digest(own) == expected.as_py():
                sets[leaf.as_py()] = own
        mine = sets.pop(hub, None)
        found = []
        for leaf, own in sets.items():
            shared = len(np.intersect1d(mine, own, assume_unique=True)) if mine is not None else -1
            if shared * (top + under) >= (len(mine) + len(own)) * top:
                found.append(leaf)
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return sent.groupBy("hub", "salt").applyInArrow(check, "a long, b long")


def connect(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) among the ``pairs`` that keep every connection by the Jaccard similarity.

    Each round every class with pairs left is verified against its smallest partner, what holds is joined, and pairs that were tried or lie
    in one component go. So a group of copies costs one comparison a member, not one a pair. Once no more than four times as many pairs are left
    as the first round tried, the last round tries them all.
    """
    left, links, most = cut(pairs), None, 0
    while n := left.count():
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("b"))
        few = n <= 4 * most
        chosen = left if few else hooks
        tried = cut(chosen.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("leaf")).distinct())
        most = most or tried.count()
        held = cut(similar(tried, texts, width, similarity))
        links = held if links is None else links.union(held)
        if few:
            break
        groups = components(links)
        by = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
        to = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
        rest = left.join(tried.select(F.col("hub").alias("a"), F.col("leaf").alias("b")), ["a", "b"], "left_anti")
        rest = rest.join(by, "a", "left").join(to, "b", "left").where("ga IS NULL OR gb IS NULL OR ga <> gb")
        left = cut(rest.select("a", "b"))
    return left if links is None else links


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, bits: int = MAX_BITS
) -> DataFrame:
    """(id, digest, component) of every row with an id: its shingle set's digest and the number of its component by the Jaccard similarity.

    Equal sets are one class from the start. SimHash links of ``bits`` bits join most copies, and all large groups
    of them, without pairs in the square of a group. What they leave (at a similarity of 0.8 fingerprints differ in some ten
    bits) comes from the prefix index: two rounds link each class of a posting list to one partner that its sketch allows, and the last round tries every
    such pair whose components still differ. Every link is verified on the whole sets. Null and empty texts
    are one class, rows that repeat are rows of one class, an id of several texts stands in the class of each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    with scratch(spark):
        prints = cut(prefixes(slim, width, similarity, common_shingles(slim, width)), keep=True)
        grouped = prints.groupBy("digest").agg(F.min(F.struct("id", "fp", "n")).alias("r"))
        classes = cut(grouped.select("digest", "r.id", "r.fp", "r.n").withColumn("node", F.monotonically_increasing_id()), keep=True)
        with scratch(spark):
            named = classes.select("digest", "id", "node")
            reps = cut(classes.groupBy("fp").agg(F.min("node").alias("rep")))
            links = near_pairs(reps.select("fp"), bits)
            ends = links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(
                reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b"
            )
            same = classes.join(reps, "fp").where("node <> rep").select("rep", "node")
            tight = cut(ends.select(F.least("ra", "rb").alias("hub"), F.greatest("ra", "rb").alias("leaf")).union(same))
            first = cut(similar(tight, _texts(slim, named, tight.toDF("a", "b")), width, similarity), keep=True)
            whole = prints.select("digest", "id", "n", "small", "prefix").dropDuplicates(["digest", "id"]).join(named, ["digest", "id"])
            postings = whole.select(F.explode("prefix").alias("shingle"), "n", "node")
            lists = cut(in_lists(postings, ["node"], shared_only, "shingle long, n int, node long"))
            named_in = lists.select("node").distinct()
            wide = whole.select("node", F.col("small").alias("sketch")).join(named_in, "node", "left_semi")
            shared = cut(lists.join(cut(wide), "node"))
            found, links = components(first), first
            for hooks in (True, True, False):
                pairs = cut(candidates(shared, found, similarity, hooks))
                ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
                sketches = cut(prints.select("digest", "id", "n", "sketch").dropDuplicates(["digest", "id"]).join(named.join(ends, "node", "left_semi"), ["digest", "id"]))
                likely = cut(plausible(pairs, sketches, similarity))
                links = links.union(cut(connect(likely, _texts(slim, named, likely), width, similarity), keep=True))
                found = components(links)
            found = cut(found, keep=True)
        by_class = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        return cut(prints.select("id", "digest").join(by_class, "digest").select("id", "digest", "component"), keep=True)


def _texts(slim: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, digest, text) of the classes in ``pairs``."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return cut(slim.join(named.join(ends, "node", "left_semi"), "id").select("node", "digest", "text"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of each component of ``near_copies``, that of the smallest id; rows of null id stay. See ``keep_rows`` for ids that repeat."""
    named = near_copies(docs, id_col, text_col, width, similarity).select("id", F.col("digest").alias("key"), "component")
    return keep_rows(docs, id_col, text_col, named, lambda rows: add_key(rows, lambda t: digest(shingle_set(t, width)), "binary"))
