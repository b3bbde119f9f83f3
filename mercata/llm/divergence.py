"""Audit of how the sources of a language diverge from each other in their words, from exact sparse count vectors."""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, remove, scratch, shared_folder

#: What a term's bytes become: A-Z lower-cased, other ASCII a space, the rest as it is.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: As many terms as an integer can count: nothing is left out of a vocabulary.
MOST_TERMS = 2**31 - 1
SCALE = 1_000_000_000
#: Terms fall into so many buckets by their hash, and ranges of buckets are shares of the vocabulary.
BUCKETS = 512


def _read(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, text as bytes), null as empty."""
    slim = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*slim).withColumn("text", F.col("text").cast("binary"))


def _named(lang: str) -> bytes:
    """What a language's terms begin with: its name in hex and a bar, which no term holds. So one vocabulary counts documents and terms for each language by itself."""
    return lang.encode().hex().encode() + b"|"


def _bucket(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


class _Numbers(dict):
    """Numbers of terms, in the order of their first occurrence."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def dealt(read: DataFrame, least_docs: int, most: int = 500_000, longest: int = 100_000) -> DataFrame:
    """(part, bucket, lang, source, terms): every term of every document in part 0, and in parts 1 to ``least_docs`` condensed documents, all dealt out by bucket.

    In part 0 the documents of a (lang, source) that a task reads stand one after another as a run, each occurrence of a term once, equal terms side by side: counts of runs add
    up as counts of documents do. A row has the terms of a bucket, at most ``longest`` of them.

    Condensed documents stand for all others of a language where only ``least_docs`` occurrences in different documents matter. A task counts, for each term of a language, the
    documents that hold it. Part 1 has all of its terms, part 2 those of two documents or more, and so on; so a term stands in as many of them as it had documents there, or in
    ``least_docs``. Each lists distinct terms.

    Terms are named and parted by spaces. A task holds about ``most`` distinct terms and 16 times as many occurrences at once, and begins anew beyond that.
    """

    def rows(numbers: dict[str, _Numbers], runs: dict[str, dict[str, list]], held: dict[str, list]) -> Iterator[tuple]:
        for lang, own in numbers.items():
            buckets = np.fromiter(map(_bucket, own), np.int32, len(own))
            order = np.argsort(buckets, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            buckets, named, found = buckets[order], _named(lang), list(own)
            words = [named + found[i] for i in order.tolist()]
            docs = np.bincount(np.concatenate(held[lang]), minlength=len(own))[order]
            lists = [(level, "", np.flatnonzero(docs >= level)) for level in range(1, least_docs + 1)]
            for part, source, at in itertools.chain(lists, ((0, s, np.sort(place[np.concatenate(ids)])) for s, ids in runs[lang].items())):
                starts = np.flatnonzero(np.diff(buckets[at], prepend=-1)).tolist()
                for start, end in zip(starts, [*starts[1:], len(at)]):
                    for i in range(start, end, longest):
                        yield part, int(buckets[at[start]]), lang, source, b" ".join([words[w] for w in at[i : min(end, i + longest)].tolist()])

    def batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["part", "bucket", "lang", "source", "terms"], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()]
        held, size = [], 0
        for row in itertools.chain(found, [None]):
            if row is not None:
                held.append(row)
                size += len(row[4]) + 100
            if held and (row is None or size > 4_000_000):
                *columns, terms = (pa.array(c, kind) for c, kind in zip(zip(*held), kinds))
                yield pa.RecordBatch.from_arrays([*columns, terms.cast(pa.string())], names)
                held, size = [], 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, runs, held, distinct, read_so_far = {}, {}, {}, 0, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms = text.translate(PLAIN).split()
                if not terms:
                    continue
                if lang not in numbers:
                    numbers[lang], runs[lang], held[lang] = _Numbers(), {}, []
                own = numbers[lang]
                distinct -= len(own)
                ids = np.fromiter(map(own.__getitem__, terms), np.int32, len(terms))
                distinct += len(own)
                read_so_far += len(terms)
                runs[lang].setdefault(source, []).append(ids)
                held[lang].append(np.unique(ids))
                if distinct > most or read_so_far > 16 * most:
                    yield from batched(rows(numbers, runs, held))
                    numbers, runs, held, distinct, read_so_far = {}, {}, {}, 0, 0
        yield from batched(rows(numbers, runs, held))

    return read.mapInArrow(work, "part int, bucket int, lang string, source string, terms string")


def condensed(read: DataFrame, least_docs: int, most: int = 500_000) -> DataFrame:
    """(bucket, terms) of the condensed documents alone."""
    return dealt(read, least_docs, most).where("part > 0").select("bucket", "terms")


def count_terms(read: DataFrame, groups: DataFrame, least_docs: int = 3, most_terms: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(tid, gid, n): occurrences in each group of the terms that stand in ``least_docs`` documents of their language or more; and (tid, code, term) of those terms.

    ``groups`` has (gid, lang, source); code is the language's name in hex. A CountVectorizer learns the vocabulary from condensed documents, so ``least_docs`` is its minDF and
    no vocabSize cuts it; its model counts every occurrence in an exact sparse vector of each run of a group's documents, and the vectors of a group are added up by their
    non-zero places, in each task first. The vocabulary is parted into shares of about ``most_terms`` distinct terms, rare ones counted, which bounds what one model holds on the
    driver and broadcasts. Documents are read once; a share is a range of buckets, by which their terms are sorted in small row groups and pages, so that each model reads little but its own share.
    """
    spark = read.sparkSession
    path = f"{shared_folder(spark)}/mercata-terms-{uuid.uuid4().hex}"
    sums, names = [], []
    try:
        small = {"parquet.block.size": 8 << 20, "parquet.page.row.count.limit": 500}
        dealt(read, least_docs).sortWithinPartitions("part", "bucket").write.options(**small).partitionBy("part").parquet(f"{path}/terms")
        table = spark.read.schema("bucket int, lang string, source string, terms string, part int").parquet(f"{path}/terms")
        terms = F.split("terms", " ").alias("terms")
        distinct = table.where("part = 1").select(F.explode(terms).alias("t")).agg(F.approx_count_distinct("t")).first()[0]
        shares = min(BUCKETS, max(1, -(-distinct // most_terms)))
        for share in range(shares):
            own = table.where((F.col("bucket") >= share * BUCKETS // shares) & (F.col("bucket") < (share + 1) * BUCKETS // shares))
            model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least_docs), vocabSize=MOST_TERMS).fit(own.where("part > 0").select(terms))
            runs = own.where("part = 0").join(groups, ["lang", "source"]).select("gid", terms)
            vector = F.unwrap_udt("vector")
            places = model.transform(runs).select("gid", F.inline(F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("x"))))
            tid = lambda c: F.col(c).cast("long") + (share << 32)
            sums.append(cut(places.groupBy("gid", "i").agg(F.sum(F.col("x").cast("long")).alias("n")).select(tid("i").alias("tid"), "gid", "n")))
            model.write().save(f"{path}/model-{share}")
            words = spark.read.parquet(f"{path}/model-{share}/data").select(F.posexplode("vocabulary").alias("i", "w"))
            parts = [F.substring_index("w", "|", 1).alias("code"), F.substring_index("w", "|", -1).alias("term")]
            names.append(cut(words.select(tid("i").alias("tid"), *parts)))
    finally:
        remove(spark, path)
    return reduce(DataFrame.unionAll, sums), reduce(DataFrame.unionAll, names)


def _p(n: str, group: str, v: str = "v") -> str:
    """SQL of the scaled share of a term that occurs ``n`` times in a group of ``group`` terms, smoothed over the ``v`` terms of its language; exact at any count."""
    wide = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return f"(1 + CAST({SCALE} AS DECIMAL(10, 0)) * {wide(f'{n} + 1')} DIV {wide(f'{group} + {v}')})"


def _f(p: str, q: str) -> str:
    """SQL of the scaled squared distance of p from q over q, in whole numbers; both are at most ``SCALE`` + 1, so the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) DIV {q})"


def _exact_sum(value: str) -> F.Column:
    """Sum of longs as a decimal, exact beyond a long: the high and the low 31 bits are added up apart."""
    return F.expr(f"CAST(sum(shiftright({value}, 31)) AS DECIMAL(20, 0)) * 2147483648 + CAST(sum({value} & 2147483647L) AS DECIMAL(20, 0))")


def _pair_values(by_term: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, other, value) for every pair of different sources of a language: f summed over all kept terms of the language.

    A term that neither source has adds the same amount, so the sum starts with v times that, corrected by the terms of one source as if the other had
    none of them (by their shares: equal ones add the same), and by the terms that both have.
    """
    mine = groups.select("lang", "v", F.col("gid").alias("g1"), F.col("p0").alias("p01"))
    theirs = groups.select("lang", F.col("gid").alias("g2"), F.col("p0").alias("p02"))
    each = mine.join(theirs, "lang").where("g1 <> g2")

    alone = by_term.select(F.explode("who").alias("a")).groupBy(F.col("a.gid").alias("g1"), F.col("a.p").alias("p1")).agg(F.count("*").alias("m"))
    alone = alone.join(each, "g1")
    alone = alone.groupBy("g1", "g2").agg(
        _exact_sum(f"m * ({_f('p1', 'p02')} - {_f('p01', 'p02')})").alias("there"),
        _exact_sum(f"m * ({_f('p02', 'p1')} - {_f('p02', 'p01')})").alias("back"),
    )
    met = by_term.select("who", F.posexplode("who").alias("at", "a")).select("a", F.explode(F.slice("who", F.col("at") + 2, F.size("who"))).alias("b"))
    change = lambda p, p0, q, q0: f"({_f(p, q)} - {_f(p, q0)} - {_f(p0, q)} + {_f(p0, q0)})"
    both = met.groupBy(F.col("a.gid").alias("g1"), F.col("b.gid").alias("g2")).agg(
        _exact_sum(change("a.p", "a.p0", "b.p", "b.p0")).alias("there"), _exact_sum(change("b.p", "b.p0", "a.p", "a.p0")).alias("back")
    )
    parts = alone.unionByName(both)
    parts = parts.select("g1", "g2", F.col("there").alias("x")).unionByName(parts.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("back").alias("x")))
    summed = parts.groupBy("g1", "g2").agg(F.sum("x").alias("x"))
    rest = F.expr(f"IF(v > 0, CAST(v AS DECIMAL(20, 0)) * {_f('p01', 'p02')}, 0)")
    return each.join(summed, ["g1", "g2"], "left").select(F.col("g1").alias("gid"), F.col("g2").alias("other"), (rest + F.coalesce("x", F.lit(0))).cast("long").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, ranks: int = 200, most_terms: int = 2_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other of its language (part ``pair``, all ranks), and the terms
    that it has more often than its language (part ``term``, up to ``ranks``).

    Null text, lang and source count as empty. Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in ``least_docs`` of its
    documents. All arithmetic is in whole numbers. A language without kept terms has pairs of value 0; one source alone has no pairs. Repeated
    rows count as often as they come, other columns are not read, an empty table gives an empty result.
    """
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    with scratch(docs.sparkSession):
        read = _read(docs, lang_col, source_col, text_col)
        found = cut(read.select("lang", "source").distinct().select(F.monotonically_increasing_id().alias("gid"), "lang", "source"))
        counts, names = count_terms(read, found, least_docs, most_terms)
        langs = names.groupBy("code").agg(F.count("*").alias("v"))
        sums = found.join(counts.groupBy("gid").agg(F.sum("n").alias("n_all")), "gid", "left").join(langs, F.lower(F.hex("lang")) == F.col("code"), "left")
        sums = sums.select("gid", "lang", "source", zero("n_all"), zero("v")).withColumn("n_lang", F.sum("n_all").over(Window.partitionBy("lang")))
        groups = cut(sums.withColumn("p0", F.expr(f"IF(v > 0, {_p('0', 'n_all')}, 0)")))

        shared = counts.join(groups.select("gid", "n_all", "v", "n_lang", "p0"), "gid").select("tid", "gid", "n", "n_lang", "v", "p0", F.expr(_p("n", "n_all")).alias("p"))
        who = F.sort_array(F.collect_list(F.struct("gid", "p", "p0"))).alias("who")  # one entry a source at most
        by_term = shared.groupBy("tid").agg(F.sum("n").alias("total"), F.first("n_lang").alias("n_lang"), F.first("v").alias("v"), who)
        by_term = cut(by_term.select("tid", F.expr(_p("total", "n_lang")).alias("q"), "who"))

        titles = groups.select("gid", "lang", "source")
        others = titles.select(F.col("gid").alias("other"), F.col("source").alias("item"))
        pairs = _pair_values(by_term, groups).join(others, "other").select("gid", "item", "value")
        own = by_term.select("tid", "q", F.explode("who").alias("w")).select("tid", "q", "w.gid", "w.p").where("p > q").join(names, "tid")
        terms = own.select("gid", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
        ranked = lambda rows, part: rows.select("gid", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        told = ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))
        return cut(told.join(titles, "gid").select("lang", "source", "part", "item", "value", "rank"), keep=True)
