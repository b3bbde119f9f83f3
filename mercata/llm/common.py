"""Shared pieces of the training-data operators: shared-folder tables, graph components, row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Tables of the operators that are running, innermost last.
_running: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only on a local master a temporary one serves where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="mercata-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside go when the block ends, unless they are kept as its result."""
    _running.append([])
    try:
        yield
    finally:
        remove(spark, *_running.pop())


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors and plan from files.

    Inside ``scratch`` the table is temporary; ``keep`` hands it to the block around, or to the caller for good.
    """
    path = f"{shared_folder(df.sparkSession)}/mercata-{uuid.uuid4().hex}"
    owners = _running[:-1] if keep else _running
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of very long texts fits a worker. Queries and pipelines call it, operators don't."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def add_key(rows: DataFrame, key_of, kind: str, text_col: str = "text") -> DataFrame:
    """``rows`` plus ``key``, the value of ``key_of`` for the UTF-8 bytes of each text; null counts as empty. ``kind``: long or binary."""
    schema = StructType([*rows.schema.fields, StructField("key", LongType() if kind == "long" else BinaryType())])
    at, arrow = rows.columns.index(text_col), pa.int64() if kind == "long" else pa.binary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key_of((t or "").encode()) for t in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "key"])

    return rows.mapInArrow(work, schema)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member reachable over the links x-y, for each of the members 0..n-1."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all() and (root[x] == root[y]).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), component = smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks two steps, and contracts the
    edges to the labels; edges inside a label and repeated ones go, so dense groups shrink at once. What a round
    leaves is written to the shared folder. Self loops are kept as isolated nodes, repeated edges are harmless, null ends are left out.
    """
    with scratch(edges.sparkSession):
        left = cut(
            edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        found = None
        while True:
            ends = left.select("a", "b").union(left.select("b", "a"))
            hooks = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
            hooks = cut(hooks)
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            labels = cut(hooks.join(up, "to").select("node", F.least("to", "further").alias("component")))
            if found is None:
                found = labels
            else:
                again = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
                found = cut(found.join(again, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
            by = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
            to = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
            moved = left.join(by, "a").join(to, "b").where("la <> lb")
            left = cut(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
            if left.isEmpty():
                return cut(found, keep=True)


def keep_rows(docs: DataFrame, id_col: str, text_col: str, named: DataFrame, with_key) -> DataFrame:
    """``docs`` with one row of each component; rows of null id, which no component names, stay.

    ``named`` has a row (id, key, component) for each row of ``docs`` with an id; ``with_key`` adds the column ``key`` to rows (id, text, row). Kept is
    the row of the smallest id, of the smallest key where that id has several, and of the smallest content hash where even those repeat. Other texts of an
    id, in components of their own, stay too. Only ids travel: those to drop, and the few that stand at several rows.
    """
    with scratch(docs.sparkSession):
        kept = cut(named.groupBy("component").agg(F.min(F.struct("id", "key")).alias("k")).select("k.id", "k.key"), keep=True)
        by_id = named.groupBy("id").agg(F.count("*").alias("n"))
        stays = kept.select("id").distinct().withColumn("stays", F.lit(True))
        fate = cut(by_id.join(stays, "id", "left").where("stays IS NULL OR n > 1").select("id", "n", F.coalesce("stays", F.lit(False)).alias("stays")), keep=True)
    once = docs.join(fate, docs[id_col] == fate["id"], "left_anti")
    several = fate.where("stays AND n > 1").select(F.col("id").alias("several_id"))
    if several.isEmpty():
        return once
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = docs.join(several, docs[id_col] == several["several_id"], "left_semi")
    again = with_key(again.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*columns).alias("row")))
    again = again.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(again.join(kept, ["id", "key"], "left_semi").select("row.*"))
