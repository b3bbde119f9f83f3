"""Secret scans: fixed patterns and sliding-window entropy. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

# Base patterns: (kind, pattern, group whose length counts, least length).
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must hold for any base pattern to yield a span; cheaper than the patterns.
HINT = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Lengths below ``least`` can be left to the pattern where a run's tail can't match once its head fails.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least Shannon entropy, in bits, of a window of a class: (pattern of the class, threshold).
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.8))
WINDOW = 20
# Allow list: shapes of harmless strings.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z+/_=-]*$",  # no digit
    r"^[0-9+/_=-]*$",  # no letter
    r"(?i)example|sample|dummy|placeholder",
    r"^(?:[A-Za-z]{2,}[0-9]{0,4}[/_-])+[A-Za-z]{2,}[0-9]{0,4}$",  # names joined by separators
)


def plain_span(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    kept = F.filter(located(text, pattern, kind, group), lambda r: F.length(r["word"]) >= least)
    return F.transform(kept, plain_span)


def located(text: Column, pattern: str, kind: int, group: int = 0, chunk: int = 128) -> Column:
    """array<struct<start, kind, end, word>> of the leftmost non-overlapping matches, in code points, end exclusive; word is the group.

    A match starts where the pieces and matches before it end; their lengths are summed by chunks, so that work stays near
    linear in the number of matches.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"), counted.alias("g"))
    rows = F.transform(
        rows,
        lambda r: F.struct(
            (F.length(r["p"]) + F.length(r["m"])).alias("step"), F.length(r["m"]).alias("size"), r["g"].alias("word")
        ),
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, r: a + r["step"])

    def placed(one: Column) -> Column:
        # one: struct(rows), bound once so that the regular expressions run once
        rows = one["rows"]
        n = F.size(rows)
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")),
            lambda c: F.struct(c.alias("no"), total(F.slice(rows, c * chunk + 1, F.lit(chunk))).alias("sum")),
        )
        starts = lambda cs: F.transform(
            cs, lambda c: F.struct(c["no"].alias("no"), F.aggregate(F.slice(cs, F.lit(1), c["no"]), F.lit(0), lambda a, x: a + x["sum"]).alias("base"))
        )
        return F.flatten(
            F.transform(
                starts(chunks),
                lambda c: F.transform(
                    F.slice(rows, c["no"] * chunk + 1, F.lit(chunk)),
                    lambda r, i: F.struct(
                        (c["base"] + total(F.slice(rows, c["no"] * chunk + 1, i + 1)) - r["size"]).alias("start"),
                        F.lit(kind).alias("kind"),
                        (c["base"] + total(F.slice(rows, c["no"] * chunk + 1, i + 1))).alias("end"),
                        r["word"].alias("word"),
                    ),
                ),
            )
        )

    bound = F.transform(F.array(F.struct(rows.alias("rows"))), lambda one: F.when(F.size(one["rows"]) > 0, placed(one)))
    return F.coalesce(bound[0], F.array().cast(PLACED))


PLACED = "array<struct<start:int,kind:int,end:int,word:string>>"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def window_entropy(word: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of ``window`` successive characters of ``word`` (at least so long).

    One pass: a step takes one character out of the window's counts and one in, and changes the sum of
    c log c by those two counts alone.
    """
    weigh = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    times = lambda part, ch: F.length(part) - F.length(F.replace(part, ch, F.lit("")))

    def best(one: Column) -> Column:
        word, first = one["word"], one["first"]
        start = F.aggregate(F.array_distinct(F.split(first, "(?!^)")), F.lit(0.0), lambda a, ch: a + weigh(times(first, ch)))

        def step(state: Column, i: Column) -> Column:
            kept = F.substring(word, i + 1, F.lit(window - 1))  # the window at i without its first character
            out = times(kept, F.substring(word, i, F.lit(1)))
            into = times(kept, F.substring(word, i + window, F.lit(1)))
            total = state["sum"] - weigh(out + 1) + weigh(out) + weigh(into + 1) - weigh(into)
            return F.struct(total.alias("sum"), F.least(state["least"], total).alias("least"))

        moves = F.filter(F.sequence(F.lit(0), F.length(word) - window), lambda i: i > 0)
        least = F.aggregate(moves, F.struct(start.alias("sum"), start.alias("least")), step)["least"]
        return F.lit(math.log2(window)) - least / window

    bound = F.struct(word.alias("word"), F.substring(word, F.lit(1), F.lit(window)).alias("first"))
    return F.transform(F.array(bound), best)[0]


def entropy_spans(text: Column, base: Column, kind: int) -> Column:
    """Spans of candidate strings of high entropy for their character class, not allow-listed and clear of ``base`` spans."""

    def suspicious(word: Column) -> Column:
        harmless = F.lit(False)
        for shape in ALLOWED:
            harmless = harmless | word.rlike(shape)
        least = F.lit(CLASSES[-1][1])
        for shape, bits in reversed(CLASSES[:-1]):
            least = F.when(word.rlike(shape), F.lit(bits)).otherwise(least)
        return F.when(harmless, F.lit(False)).otherwise(window_entropy(word) >= least)

    found = F.filter(located(text, CANDIDATE, kind), lambda s: suspicious(s["word"]))
    clear = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.transform(clear, plain_span)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``secret_spans``: array<struct<start, kind, end>> by start, then kind (0 assign, 1 access, 2 hex, 3 entropy).

    Null and empty texts have no spans. Base spans of different kinds may overlap; entropy spans overlap no base span.
    A column ``secret_spans`` is replaced, all other columns stay. Every whole text is read; a cheap pattern first finds the few texts that need positions.
    """
    text = F.col(text_col)
    base = F.lit(None).cast(SPANS)
    parts = []
    for no, (kind, pattern, group, least) in enumerate(PATTERNS):
        used, by = (FAST[kind], 0) if kind in FAST else (pattern, group)
        parts.append(F.when(text.rlike(HINT[kind]), spans_of(text, used, no, by, least)).otherwise(F.array().cast(SPANS)))
    held = fresh(docs, "_base")
    out = docs.withColumn(held, F.coalesce(F.concat(*parts), F.array().cast(SPANS)))
    # a candidate needs a digit within a run; most long words have none and stop here
    hint = text.rlike(r"[A-Za-z0-9+/_=-]{20}") & text.rlike(r"[A-Za-z+/_=-][0-9]|[0-9][A-Za-z+/_=-]")
    more = F.when(hint, entropy_spans(text, F.col(held), len(PATTERNS))).otherwise(F.array().cast(SPANS))
    return out.withColumn("secret_spans", F.array_sort(F.concat(held, F.coalesce(more, F.array().cast(SPANS))))).drop(held)


def redact(docs: DataFrame, text_col: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; spans that overlap or touch share one mark."""
    text = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = (x["start"] > s["at"]) | (s["out"] == "")
        kept = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, kept).otherwise(s["out"]).alias("out"))

    done = F.aggregate(F.col(spans), state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row; see ``find_secrets``."""
    kinds = F.array(*[F.lit(p[0]) for p in PATTERNS], F.lit("entropy"))
    write = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("secret_spans", lambda s: s["kind"] < len(PATTERNS))
    of_kind = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{p[0]}") for k, p in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(write(base), 256).alias("base_sha256"), write(F.col("secret_spans")).alias("spans"))
