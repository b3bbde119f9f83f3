"""Spelling variants of a corpus's words by a dictionary of trie-node pairs."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, scratch

#: Nodes and words that are numbered in one range of the sorted words: their number is the range's, shifted by so many bits, plus a count.
RANGE_BITS = 40
#: Kinds of members of a pair of nodes: the word itself, a word whose skipped letter begins a run of equal ones, a word whose skipped letter repeats the one before.
SPLIT, SKIP, SKIP_IN_RUN = 0, 1, 2


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, delete_every: int | None = 199) -> DataFrame:
    """(word, n): occurrences of the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased, of at least ``least_length`` letters.

    With ``delete_every``, a run whose crc32 of ``<id>:<run>`` that number divides first loses its letter at crc32 modulo its length. Null text has no
    words, a null id counts as empty text. Repeated rows count as often as they come; other columns are not read. Counts are summed in each task first.
    """
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_length)
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(runs.findall(text.lower()))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    if delete_every and (h := zlib.crc32(word, start)) % delete_every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) == least_length:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    total[word] += n
            if len(total) > 200_000:
                yield out(total)
                total = Counter()
        yield out(total)

    return slim.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def boundary_paths(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int], str, list[int]]]:
    """By range: the prefix it shares with the range before and the numbers of its nodes, then the same with the range after.

    ``ends`` has (range, first word, last word) in order. A node whose words lie in several ranges is a prefix of the last word of one and of the
    first word of the next, so it lies on one of these paths; words between two that share a prefix share it too, so a path only takes over
    numbers from the path before it. Numbers run from 1; the root is 0.
    """
    paths, found, text, numbers, used = {}, [], "", [], 0
    for (_, _, last), (_, first, _) in zip(ends, ends[1:]):
        shared = os.path.commonprefix([last, first])
        same = len(os.path.commonprefix([text, shared]))
        numbers = numbers[:same] + list(range(used + 1, used + 1 + len(shared) - same))
        used, text = used + len(shared) - same, shared
        found.append((text, numbers))
    for i, (part, _, _) in enumerate(ends):
        paths[part] = (*(found[i - 1] if i else ("", [])), *(found[i] if i < len(found) else ("", [])))
    return paths


def number_trie(words: DataFrame) -> DataFrame:
    """``words`` (w, distinct, and other columns) plus ``number``, which keeps the order of ``w``, and ``nodes``: the trie nodes of its prefixes, shortest first.

    The words are range-partitioned and sorted, so the nodes of a word are those of the word before it up to their common prefix, and new ones
    after it: each range is one streaming pass that holds a single path. Ranges learn only the prefixes they share with their neighbours (two words
    a range pass through the driver).
    """
    with scratch(words.sparkSession):
        ranged = cut(words.repartitionByRange("w").sortWithinPartitions("w").withColumn("part", F.spark_partition_id()), keep=True)
    ends = ranged.groupBy("part").agg(F.min("w").alias("first"), F.max("w").alias("last")).orderBy("part").collect()
    paths = boundary_paths([tuple(r) for r in ends])
    at_part, at_word = ranged.columns.index("part"), ranged.columns.index("w")
    kept = [i for i, c in enumerate(ranged.columns) if c != "part"]
    schema = ", ".join(f"`{ranged.columns[i]}` {ranged.dtypes[i][1]}" for i in kept) + ", number long, nodes array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, words_seen, nodes_made, right, right_path = None, "", [], 0, 0, "", []
        for batch in batches:
            numbers, nodes, sizes = [], [], [0]
            for own, word in zip(batch.column(at_part).to_pylist(), batch.column(at_word).to_pylist()):
                if own != part:
                    part, words_seen, nodes_made = own, 0, 0
                    before, path, right, right_path = paths[part]
                    path = [0, *path]
                same = len(os.path.commonprefix([before, word]))
                path = path[: same + 1]
                if same < len(word):
                    on_right = max(len(os.path.commonprefix([right, word])), same)
                    path += right_path[same:on_right]
                    base = (part + 1 << RANGE_BITS) + nodes_made
                    path += range(base, base + len(word) - on_right)
                    nodes_made += len(word) - on_right
                numbers.append((part + 1 << RANGE_BITS) + words_seen)
                words_seen += 1
                nodes += path
                sizes.append(len(nodes))
                before = word
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(numbers, pa.int64()), lists], [*(batch.schema.names[i] for i in kept), "number", "nodes"])

    return ranged.repartition("part").sortWithinPartitions("part", "w").mapInArrow(work, schema)


def pair_dictionary(numbered: DataFrame) -> DataFrame:
    """(p, s, kind, number, n): of each word, the pairs (prefix node, suffix node) around each of its cuts, and around each letter skipped.

    ``numbered`` has (number, n, w, forward, backward), the nodes of the word and of its reverse. A word's own cuts stand for words with a letter more.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s, kind, number, n = [], [], [], [], []
            for row_number, row_n, word, forward, backward in zip(*(batch.column(i).to_pylist() for i in range(5))):
                p += forward
                s += backward[::-1]
                kind += [SPLIT] * len(forward)
                p += forward[:-1]
                s += backward[-2::-1]
                kind += [SKIP] * bool(word)
                kind += [SKIP_IN_RUN if a == b else SKIP for a, b in zip(word, word[1:])]
                number += [row_number] * (2 * len(word) + 1)
                n += [row_n] * (2 * len(word) + 1)
            columns = [np.array(c, np.int64) for c in (p, s, kind, number, n)]
            for at in range(0, len(p), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["p", "s", "kind", "number", "n"])

    return numbered.select("number", "n", "w", "forward", "backward").mapInArrow(work, "p long, s long, kind long, number long, n long")


def near_words(pairs: DataFrame) -> DataFrame:
    """(number, n_near, best): how many words are one edit away, and the struct (minus its n, number) of the most frequent, smallest of them.

    The words at a pair of nodes are x + y itself and words x + letter + y, so a pair has no more of them than there are letters, and one. Words with a
    skipped letter there are replacements of each other; x + y misses a letter of each. A letter may be left out anywhere in a run
    of equal letters with the same result, so only the run's first place counts for that. Thus two words meet exactly once.
    """
    # one word cannot be at a pair twice: its skipped and its whole cuts have different lengths, and equal pairs have equal places
    alike = "(m.kind > 0 AND o.kind > 0 OR m.kind + o.kind = 1)"
    members = F.sort_array(F.collect_list(F.struct(F.expr("-n").alias("less"), "number", "kind")))
    grouped = pairs.groupBy("p", "s").agg(members.alias("members")).where("size(members) > 1")
    others = F.expr(f"transform(members, m -> struct(m.number AS number, filter(members, o -> o.number <> m.number AND {alike}) AS others))")
    each = grouped.select(F.explode(others).alias("m")).where("size(m.others) > 0")
    each = each.select("m.number", F.expr("size(m.others)").alias("k"), F.expr("struct(m.others[0].less AS less, m.others[0].number AS number)").alias("first"))
    return each.groupBy("number").agg(F.sum(F.col("k").cast("long")).alias("n_near"), F.min("first").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(number, root) from acyclic ``links`` (number, to): the last one reached. Each round doubles the steps; a chain's counts grow by a factor, so rounds are few."""
    with scratch(links.sparkSession):
        at = cut(links.select("number", F.col("to").alias("root"), F.lit(True).alias("moved")))
        while not at.where("moved").isEmpty():
            onward = at.select(F.col("number").alias("root"), F.col("root").alias("further"))
            at = cut(at.join(onward, "root", "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        return cut(at.select("number", "root"), keep=True)


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct words of ``counts`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of the largest n (ties: smallest in code-point
    order) if that n is at least ``ratio`` times the word's, else null; ``root`` is the last word reached by following forms. Rows of null word are
    left out, an empty table gives an empty result, words may be of any length: work and memory grow with the letters.
    """
    with scratch(counts.sparkSession):
        words = cut(number_trie(counts.where("word IS NOT NULL").select(F.col("word").alias("w"), "n")).withColumnRenamed("nodes", "forward"))
        backward = number_trie(words.select(F.reverse("w").alias("w"), F.col("number").alias("of")))
        backward = backward.select(F.col("of").alias("number"), F.col("nodes").alias("backward"))
        near = cut(near_words(pair_dictionary(words.join(backward, "number"))))
        best = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
        told = words.join(near, "number", "left").select("number", F.col("w").alias("word"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best.alias("b"))
        told = cut(told.select("number", "word", "n", "n_near", F.col("b.number").alias("to"), (-F.col("b.less")).alias("form_n")), keep=True)
        roots = cut(follow(told.where("to IS NOT NULL").select("number", "to")), keep=True)
    names = told.select(F.col("number").alias("to"), F.col("word").alias("form"))
    root_names = told.select(F.col("number").alias("root"), F.col("word").alias("root_word"))
    linked = told.where("to IS NOT NULL").join(roots, "number").join(names, "to").join(root_names, "root")
    linked = linked.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = told.where("to IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.unionByName(alone)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, ratio: int = 5, least_length: int = 6, delete_every: int | None = 199) -> DataFrame:
    """``variants`` of the words of whole texts that occur ``least`` times or more; see ``count_words`` for what is a word, for nulls and repeats."""
    with scratch(docs.sparkSession):
        counts = cut(count_words(docs, id_col, text_col, least_length, delete_every).where(F.col("n") >= least))
        found = variants(counts, ratio)
        return cut(found, keep=True)
