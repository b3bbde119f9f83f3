"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, scratch

# Fixed word lists of the grammar, by role; a trailing * takes any ending. English, German, French, Spanish, each in the order of its alphabet.
INSULTS = (
    "bastard* coward* creep* disgusting dumb fool* freak* idiot* imbecile* jerk* liar* loser* moron* pathetic pig* scum stupid trash ugly vermin worthless "
    "abschaum arschloch blöd* dreckig* dumm* feigling* idiotin* schwachkopf* trottel* versager* widerlich* "
    "abruti* crétin* débile* imbécile* lâche* minable* ordure* pourri* salaud* stupide* "
    "asqueroso* basura cobarde* escoria estúpid* idiota* imbécil* inútil* miserable* tonto*"
)
THREATS = (
    "beat burn crush destroy hang hurt kill murder shoot stab strangle töte* umbringen verbrenne* vernichte* verprügel* zerstör* "
    "détruir* frapper* tuer* étrangler* destrui* golpear* matar* quemar*"
)
TARGETS = "he her him she them they u ur you your yours dich dir du euch ihr sie elle il ils lui te toi tu vous ellos ti usted ustedes"
NEGATIONS = "aren't don't isn't never no not wasn't without won't kein keine nicht nie jamais ne pas sans jamás ni nunca sin"
REPORTS = "accused called calls claimed quoted said says wrote behauptete nannte sagte schrieb appelé disait dit écrit dijo escribió llamó"
#: Weight of a fixed insult or threat of which the labels say nothing, and the number of texts that this counts for.
PRIOR, PRIOR_TEXTS = 0.35, 2.0

CLAUSE_END = regex.compile(r"[.!?;\n]")
WORD = regex.compile(r"[\w']+")


class Transducer:
    """A finite-state transducer over role symbols: ``step(state, symbol) -> (state, output symbol, factor)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: this machine's output is the other's input; factors multiply."""

        def step(state, symbol):
            a, mid, f = self.step(state[0], symbol)
            b, out, g = other.step(state[1], mid)
            return (a, b), out, f * g

        return Transducer((self.start, other.start), step)

    def table(self, alphabet: str) -> dict:
        """All transitions that can be reached, as {(state number, symbol): (state number, output, factor)}."""
        number, todo, out = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                after, said, factor = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                out[number[state], symbol] = (number[after], said, factor)
        return out


# Symbols: I insult, H threat, Y target, N negation, R report, w other word, E end of clause; i and h are an insult or threat that is negated
# or only reported. At the end of a clause the machines say what it was: E nothing addressed, A somebody addressed, B an addressed
# insult, T an addressed threat, C both.
ALPHABET = "IHYNRwE"
SOFT = {"I": "i", "H": "h"}


def _negation(left: int, symbol: str):
    """An insult or threat within three words of a negation is negated."""
    if symbol == "E":
        return 0, symbol, 1.0
    if symbol == "N":
        return 3, symbol, 1.0
    if symbol in SOFT and left:
        return left - 1, SOFT[symbol], 0.4
    return max(0, left - 1), symbol, 1.0


def _report(on: bool, symbol: str):
    """What follows a verb of speech in its clause is somebody else's word."""
    if symbol == "E":
        return False, symbol, 1.0
    if symbol in SOFT and on:
        return on, SOFT[symbol], 0.5
    return on or symbol == "R", symbol, 1.0


def _target(on: bool, symbol: str):
    """A clause in which somebody is named or spoken to, before or after, ends addressed."""
    if symbol == "E":
        return False, "A" if on else "E", 1.0
    return on or symbol == "Y", symbol, 1.0


def _insult(on: bool, symbol: str):
    """An addressed clause with an insult is an insult to somebody."""
    if symbol in "EA":
        return False, "B" if on and symbol == "A" else symbol, 1.0
    return on or symbol in "Ii", symbol, 1.0


def _threat(on: bool, symbol: str):
    """An addressed clause with a threat is a threat to somebody."""
    if symbol in "EAB":
        return False, {"A": "T", "B": "C"}.get(symbol, symbol) if on else symbol, 1.0
    return on or symbol in "Hh", symbol, 1.0


GRAMMAR = (
    Transducer(0, _negation)
    .then(Transducer(False, _report))
    .then(Transducer(False, _target))
    .then(Transducer(False, _insult))
    .then(Transducer(False, _threat))
)
#: A match that is aimed at somebody has its odds multiplied by this; a threat that isn't keeps this share of its weight.
AIMED, AIMLESS = 5.0, 0.3


def clause_weight(end: str, insult: float, threat: float) -> float:
    """The score of a clause from how it ends and its heaviest insult and threat."""
    aimed = lambda p: AIMED * p / (1 + (AIMED - 1) * p)
    insult = aimed(insult) if end in "BC" else insult
    threat = aimed(threat) if end in "TC" else AIMLESS * threat
    return max(insult, threat)


@dataclass
class Lexicon:
    """Symbol and weight of words (``word``) and stems (``word*``)."""

    terms: dict[str, tuple[str, float]] = field(default_factory=dict)

    @classmethod
    def fixed(cls) -> Lexicon:
        roles = (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS), ("I", INSULTS))
        return cls({w: (s, PRIOR if s in SOFT else 0.0) for s, words in roles for w in words.split()})

    def find(self, word: str) -> tuple[str, float]:
        """Of the term that is the word, else of its longest stem."""
        got = self.terms.get(word)
        if got:
            return got
        for n in range(len(word), 2, -1):
            got = self.terms.get(word[:n] + "*")
            if got:
                return got
        return "w", 0.0


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column | None, per_class: int, seed: int = 5) -> tuple[DataFrame, float]:
    """Labelled texts (doc_id, text, toxic), at most ``per_class`` of each label, the first by a hash of the id; and how many clean rows one of the
    sample stands for where a toxic one stands for one."""
    named = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    if keep is not None:
        named = named.where(keep)
    order = F.xxhash64("id", F.lit(seed))
    chosen = None
    for label in (0, 1):
        part = named.where(F.col("toxic") == label).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    size = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    scale = (good / min(good, per_class)) / (bad / min(bad, per_class)) if bad and good else 1.0
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "id").select(F.col("id").alias("doc_id"), "text", "toxic"), scale


def _stems(words: Column, size: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.concat(F.substring(w, 1, size), F.lit("*")))


def without_copies(rows: DataFrame, seeds: tuple[int, ...] = (1, 2, 3), width: int = 5) -> DataFrame:
    """One row for each group of texts that share the smallest hash of their word shingles, under each seed in turn.

    Copies and near copies are not independent witnesses: the chance words of one much copied text would look like marks of its label.
    """
    for seed in seeds:
        words = F.split(F.lower("text"), r"\s+")
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(width)), " "), F.lit(seed)))
        marked = rows.withColumn("_w", words).withColumn("_least", F.array_min(runs))
        rows = marked.groupBy("toxic", "_least").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "toxic")
    return rows


def _outdone(term: str, found: dict[str, tuple[int, int]]) -> bool:
    """Whether a longer taken term stands for nearly the same toxic texts as a stem, or for most of them and fewer others."""
    if not term.endswith("*"):
        return False
    bad, good = found[term]
    longer = [v for t, v in found.items() if len(t.rstrip("*")) > len(term) - 1 and t.startswith(term[:-1])]
    return any(b >= 0.95 * bad or b >= 0.8 * bad and g < good for b, g in longer)


def learn(
    rows: DataFrame, scale: float = 1.0, prefixes: tuple[int, ...] = (4, 5, 6, 7), ratio: float = 40.0, rounds: int = 3, sure: float = 0.5
) -> Lexicon:
    """The fixed lists with weights, and the words and stems that mark toxic texts, all from the labelled ``rows``.

    Copies count once (``without_copies``). A word or stem is taken if toxic texts hold it ``ratio`` times as often as others and the excess
    has, by the Chernoff bound of the binomial tail, a chance of less than one in ten among all candidates. Stems that a
    taken stem covers are left out, and stems that a longer one does as well as. Each further round learns from the rows that the words so far
    do not explain, which brings out terms of small languages. A term's weight is the share of toxic texts among all that hold it, where
    a clean row of the sample stands for ``scale`` rows; fixed terms start from ``PRIOR``, and learned ones need a share of ``sure``. Only terms
    that pass come to the driver: at most some per toxic text.
    """
    with scratch(rows.sparkSession):
        rows = cut(without_copies(rows))
        words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))
        words = F.filter(words, lambda w: F.length(w) >= 3)
        stems = [_stems(words, n) for n in prefixes]
        keys = F.array_distinct(F.concat(words, *stems))
        fixed = Lexicon.fixed().terms
        lengths = sorted({len(t) - 1 for t, (s, _) in fixed.items() if s in SOFT and t.endswith("*")} | set(prefixes))
        all_keys = F.array_distinct(F.concat(words, *[_stems(words, n) for n in lengths]))

        def counted(part: DataFrame, terms: Column) -> DataFrame:
            by_term = part.select("toxic", F.explode(terms).alias("term")).groupBy("term")
            return by_term.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))

        everywhere = cut(counted(rows, all_keys).where("bad > 0 OR good > 0"))

        def evidence(terms: list[str]) -> dict[str, tuple[int, int]]:
            named = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
            return {r["term"]: (r["bad"], r["good"]) for r in everywhere.join(F.broadcast(named), "term").collect()}

        known = {}
        seen = evidence([t for t, (s, _) in fixed.items() if s in SOFT])
        for term, (symbol, weight) in fixed.items():
            bad, good = seen.get(term, (0, 0))
            known[term] = (symbol, (bad + PRIOR * PRIOR_TEXTS) / (bad + scale * good + PRIOR_TEXTS) if symbol in SOFT else weight)
        lexicon, left = Lexicon(known), rows
        for _ in range(rounds):
            size = {r["toxic"]: r["n"] for r in left.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
            bad, good = size.get(1, 0), size.get(0, 0)
            if not bad or not good:
                break
            base = bad / (bad + good)
            counts = cut(counted(left, keys).where("bad > 0"))
            share = F.col("bad") / (F.col("bad") + F.col("good"))
            spread = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
            taken = counts.where(
                ((F.col("bad") + 0.5) / (bad + 1) > ratio * (F.col("good") + 0.5) / (good + 1))
                & ((F.col("bad") + F.col("good")) * spread > math.log(10 * max(1, counts.count())))
            )
            found = {r["term"]: (r["bad"], r["good"]) for r in taken.select("term", "bad", "good").collect()}
            seen, before = evidence(list(found)) if found else {}, len(known)
            for term in sorted(found, key=lambda t: (not t.endswith("*"), len(t), t)):
                yes, no = seen.get(term, found[term])
                weight = (yes + base) / (yes + scale * no + 1)
                if weight >= sure and Lexicon(known).find(term.rstrip("*"))[0] == "w" and not _outdone(term, found):
                    known[term] = ("I", weight)
            lexicon = Lexicon(dict(known))
            if len(known) == before:
                break
            scored = score_toxicity(rows, lexicon).where("score < 0.5").select("doc_id")
            left = rows.join(scored, "doc_id", "left_semi")
        return lexicon


class Scorer:
    """Scores texts: the chance that at least one matched clause is toxic."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.table = lexicon, GRAMMAR.table(ALPHABET)
        self.hits = ahocorasick.Automaton()
        for term, (symbol, _) in lexicon.terms.items():
            if symbol in SOFT:
                self.hits.add_word(term.rstrip("*"), len(term.rstrip("*")))
        self.hits.make_automaton()

    def clause(self, clause: str) -> float:
        """Runs the composed machine over the clause's words."""
        state, insult, threat = 0, 0.0, 0.0
        for word in WORD.findall(clause):
            symbol, weight = self.lexicon.find(word)
            state, said, factor = self.table[state, symbol]
            if said in "Ii":
                insult = max(insult, weight * factor)
            elif said in "Hh":
                threat = max(threat, weight * factor)
        return clause_weight(self.table[state, "E"][1], insult, threat)

    def __call__(self, text: str | None) -> float:
        if not text or not len(self.hits):
            return 0.0
        low, clean, done = text.lower(), 1.0, 0
        for end, size in self.hits.iter(low):
            start = end - size + 1
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            left = max(done, *(low.rfind(c, done, start) + 1 for c in ".!?;\n"))
            after = CLAUSE_END.search(low, end)
            done = after.end() if after else len(low)
            clean *= 1 - self.clause(low[left:done])
        return 1.0 - clean


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): every row's chance of a toxic clause, from 0 to 1.

    Lexical roles (learned and fixed) go through the composed negation, reported-speech, target, insult and threat transducers;
    each clause counts its strongest match (``clause_weight``) and clauses combine as independent. Null, empty and
    match-free texts score 0. Repeated rows score alike; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            scores = np.array([scorer(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return slim.mapInArrow(work, f"doc_id {slim.schema[0].dataType.simpleString()}, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 6000, hold_out: bool = True
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; see ``score_toxicity`` and ``learn``.

    Terms are learned from at most ``per_class`` labelled rows of each label whose crc32(doc_id as text) mod 3 is not 1
    (``hold_out``). A null id is not held out.
    """
    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    lexicon = learn(*training_rows(docs, labels, ~fold("id") if hold_out else None, per_class))
    return score_toxicity(docs, lexicon).select(
        "doc_id", fold("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 6000, hold_out: bool = True, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; learned as in ``toxicity``; nothing but the sample moves."""
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    lexicon = learn(*training_rows(docs, labels, ~fold if hold_out else None, per_class))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            clean = [scorer(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
