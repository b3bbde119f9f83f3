"""Mixing documents to target domain weights with soft membership. DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh, scratch

#: Domains over the labelled table: (name, condition on its columns). A labelled row counts for the first that holds.
DOMAINS = (("toxic", "toxic = 1"), ("poor", "quality = 0"), ("prose", "quality = 1"))
TARGETS = {"prose": 0.85, "poor": 0.10, "toxic": 0.05}
QUALITY_DOMAINS = (("poor", "quality = 0"), ("prose", "quality = 1"))
QUALITY_TARGETS = {"prose": 0.92, "poor": 0.08}


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of ``text``; those of under two or over forty letters and digits tell no domain."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{2,40}(?![\p{L}\p{N}])"), F.lit(0)))


def features(text: Column, words: Column, terms: list[list[str]]) -> list[Column]:
    """Cheap signs of a text's kind: length, marks, capitals, repetition, word length and the share of each domain's learned terms."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    rate = lambda found, of: F.log1p(100.0 * found / F.greatest(of, F.lit(1)))
    return [
        F.log1p(n.cast("double")),
        rate(F.regexp_count(text, F.lit(r"[#$%&*|!]")), n),
        rate(F.regexp_count(text, F.lit(r"\p{Lu}")), n),
        F.size(words) / F.greatest(n, F.lit(1)),
        F.length(text) / F.greatest(n, F.lit(1)),
        *[rate(F.size(F.array_intersect(words, F.array(*map(F.lit, t)))) if t else F.lit(0.0), F.size(words)) for t in terms],
    ]


def posteriors(x: Column, model: list[tuple[float, list[float], list[float]]]) -> Column:
    """array<double> of P(domain | features) under (log prior, means, variances) of each domain; a domain without rows has 0."""
    scores = []
    for prior, means, variances in model:
        total = F.lit(float(prior))
        for j, (m, v) in enumerate(zip(means, variances)):
            total = total - 0.5 * ((x[j] - m) * (x[j] - m) / float(v) + float(np.log(v)))
        scores.append(total)
    def soft(one: Column) -> Column:
        top = F.array_max(one)
        weights = F.transform(one, lambda s: F.exp(F.greatest(s - top, F.lit(-700.0))))
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        return F.transform(weights, lambda w: w / total)

    return F.transform(F.array(F.array(*scores)), soft)[0]


def labelled(labels: DataFrame, domains, sample: int, seed: int = 3) -> DataFrame:
    """(_id, domain) of at most ``sample`` labelled rows, the first by a hash of the id; a row counts for its first domain that holds."""
    domain = F.lit(None).cast("int")
    for d, (_, condition) in reversed(list(enumerate(domains))):
        domain = F.when(F.expr(condition), F.lit(d)).otherwise(domain)
    named = labels.select(F.col("doc_id").alias("_id"), domain.alias("domain")).where("_id IS NOT NULL AND domain IS NOT NULL")
    return named.groupBy("_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample)


def fit_terms(docs: DataFrame, named: DataFrame, domains: int, most: int = 256, least_z: float = 4.0, least_rows: int = 5) -> list[list[str]]:
    """Words that mark each domain: the ``most`` of highest z of their log odds against the other domains among the labelled rows.

    ``docs``: (_id, text). Words of under ``least_rows`` rows or a z under ``least_z`` are left out, so chance words stay few.
    """
    with scratch(docs.sparkSession):
        # written once: texts of labelled rows only, and their words are read several times below
        rows = cut(docs.join(F.broadcast(named), "_id").select("domain", words_of(F.col("text")).alias("words")))
        totals = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
        counts = rows.select("domain", F.explode("words").alias("w")).groupBy("w").agg(
            F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(domains)]
        )
        per = []
        for d in range(domains):
            inside, outside = totals.get(d, 0), sum(totals.values()) - totals.get(d, 0)
            a, b = F.col(f"n{d}"), F.col("n") - F.col(f"n{d}")
            cells = [a + 0.5, inside - a + 0.5, b + 0.5, outside - b + 0.5]
            z = (F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])) / F.sqrt(sum(1.0 / c for c in cells))
            per.append(F.struct(F.lit(d).alias("d"), z.alias("z")))
        marked = cut(counts.where(F.col("n") >= least_rows).select("w", F.inline(F.array(*per))).where(F.col("z") >= least_z))
        best = [marked.where(F.col("d") == d).orderBy(F.desc("z"), "w").limit(most) for d in range(domains)]
        return [[r["w"] for r in one.collect()] for one in best]


def fit_classifier(scored: DataFrame, named: DataFrame, domains: int, width: int) -> list[tuple[float, list[float], list[float]]]:
    """Gaussian class model of the ``width`` features of the labelled rows. ``scored``: (_id, x)."""
    rows = scored.join(F.broadcast(named), "_id")
    sums = [f(F.col("x")[j]).alias(f"{k}{j}") for j in range(width) for k, f in (("m", F.avg), ("v", F.var_pop))]
    found = {r["domain"]: r for r in rows.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()}
    total = sum(r["n"] for r in found.values()) or 1
    model = []
    for d in range(domains):
        r = found.get(d)
        if r is None:
            model.append((0.0 if not found else -600.0, [0.0] * width, [1.0] * width))
        else:
            model.append((float(np.log(r["n"] / total)), [r[f"m{j}"] for j in range(width)], [max(r[f"v{j}"], 0.05) for j in range(width)]))
    return model


def rate_after(p: Column, steps: list[np.ndarray]) -> Column:
    """The rate of a document after projected steps from 1: r <- max(0, r + p . step), in order."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + dot(s)))


def fit_rates(scored: DataFrame, weights: np.ndarray, total: float | None, rounds: int = 40, tolerance: float = 1e-6) -> list[np.ndarray]:
    """Projected-gradient least squares on the expected domain totals sum_i r_i t_i p_i; the steps taken.

    Each round is one aggregation over all documents: it sums the totals, and the matrix of t p p' over documents
    whose rate is above zero, which scales the gradient. The step is shortened until the residual falls. Only these
    D x D numbers come to the driver. ``total`` is by default the least sum at which no domain shrinks.
    """
    d = len(weights)
    p, t = F.col("p"), F.col("tokens").cast("double")

    def measure(candidates: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        sums = []
        for k, steps in enumerate(candidates):
            r = rate_after(p, steps)
            sums += [F.sum(r * t * p[a]).alias(f"s{k}_{a}") for a in range(d)]
            sums += [F.sum(F.when(r > 0, t * p[a] * p[b]).otherwise(0.0)).alias(f"m{k}_{a}_{b}") for a in range(d) for b in range(a, d)]
        row = scored.agg(*sums).first()
        out = []
        for k in range(len(candidates)):
            m = np.zeros((d, d))
            for a in range(d):
                for b in range(a, d):
                    m[a, b] = m[b, a] = row[f"m{k}_{a}_{b}"] or 0.0
            out.append((np.array([row[f"s{k}_{a}"] or 0.0 for a in range(d)]), m))
        return out

    steps: list[np.ndarray] = []
    sums, matrix = measure([steps])[0]
    if not sums.sum():
        return steps
    if total is None:
        total = float(max(s / w for s, w in zip(sums, weights) if w > 0))
    goal = weights * total
    for _ in range(rounds):
        error = goal - sums
        if np.abs(error).max() <= tolerance * total:
            break
        step = np.linalg.lstsq(matrix, error, rcond=1e-9)[0]
        tried = [[*steps, step * f] for f in (1.0, 0.5, 0.2, 0.05)]
        results = measure(tried)
        best = min(range(len(tried)), key=lambda k: float(((goal - results[k][0]) ** 2).sum()))
        if ((goal - results[best][0]) ** 2).sum() >= (error**2).sum() * (1 - 1e-9):
            break
        steps, (sums, matrix) = tried[best], results[best]
    return steps


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domains=DOMAINS,
    targets: dict[str, float] = TARGETS,
    total_tokens: float | None = None,
    sample: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
) -> DataFrame:
    """``docs`` plus tokens, posteriors (in the order of ``domains``), rate and copies for every row.

    A classifier fitted on at most ``sample`` labelled rows, its terms learned from them too, gives each document a posterior over the domains. Rates are fitted over
    all documents so that expected domain token totals (white-space words) meet ``targets`` of the whole, which is by default
    the least size at which no domain shrinks. ``copies`` is the rate's whole part and one more with the chance of
    its fraction, decided by a hash of the id. Null and empty texts have 0 tokens and a rate like any other; rows that repeat
    are weighed each and decided alike. A domain without labelled rows gets no mass. Columns of these names are replaced.
    """
    plain = docs.drop("tokens", "posteriors", "rate", "copies")
    x, w = fresh(plain, "features"), fresh(plain, "words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = labelled(labels, domains, sample)
    terms = fit_terms(plain.select(F.col(id_col).alias("_id"), text.alias("text")), named, len(domains))
    columns = features(text, F.col(w), terms)
    worded = plain.withColumns({"tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long"), w: words_of(text)})
    held = cut(worded.withColumn(x, F.array(*columns)).drop(w))
    model = fit_classifier(held.select(F.col(id_col).alias("_id"), F.col(x).alias("x")), named, len(domains), len(columns))
    scored = held.withColumn("posteriors", posteriors(F.col(x), model)).drop(x)
    weights = np.array([float(targets.get(name, 0.0)) for name, _ in domains])
    steps = fit_rates(scored.select("tokens", F.col("posteriors").alias("p")), weights / weights.sum(), total_tokens)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    rated = scored.withColumn("rate", rate_after(F.col("posteriors"), steps))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rated.withColumn("copies", copies)
