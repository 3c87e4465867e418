"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from claimloom.llm.language_id import held_out
from claimloom.llm.native import let
from claimloom.llm.storage import Workspace, others, unused
from claimloom.llm.text import SPACE, texts

TRAINING_ROWS = 12_000
CANDIDATES = 2_000
LEXICON = 500
# How much more often an entry has to be in toxic rows than in others.
RATIO = 30

# Function words of the grammar, in four languages.
THREATS = "kill hurt destroy beat shoot stab töten verletzen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he she they him her them du dich ihr sie tu toi vous il elle usted ustedes él ella ellos".split()
NEGATIONS = "not no never don't doesn't isn't aren't nicht kein keine nie ne pas jamais nunca ni jamás".split()
REPORTS = "said says wrote writes called reported quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

TOKEN = regex.compile(r"[\p{L}\p{M}']+|[.!?;:\n]")
STOPS = frozenset(".!?;:\n")
# A clause's classes: a bare insult, one aimed at somebody, a threat aimed at somebody, and the first three again where
# the clause negates or reports them.
CLASSES = ["insult", "aimed", "threat", "negated", "reported"]


@dataclass
class Grammar:
    """Lexicon of insults and weights of clause classes, as learnt."""

    insults: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES) + 1))


class Transducer:
    """Reads symbols and stays in a state; arcs are (state, symbol) -> state, and symbols without an arc leave it."""

    def __init__(self, arcs: dict[tuple[int, str], int]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> int:
        return self.arcs.get((state, symbol), state)


# Each machine says with its state what it has read of a clause so far.
INSULT = Transducer({(0, "insult"): 1})
THREAT = Transducer({(0, "threat"): 1})
TARGET = Transducer({(0, "target"): 1})
NEGATION = Transducer({(0, "negation"): 1, (1, "negation"): 0})  # a second negation takes the first back
REPORT = Transducer({(0, "report"): 1})
MACHINES = (INSULT, THREAT, TARGET, NEGATION, REPORT)


def composed() -> tuple[dict[tuple[int, str], int], list[tuple[int, ...]]]:
    """The machines run side by side as one: its arcs and, of every state, the states of the five."""
    symbols = ("insult", "threat", "target", "negation", "report")
    states: list[tuple[int, ...]] = [(0,) * len(MACHINES)]
    arcs: dict[tuple[int, str], int] = {}
    for at in range(2 ** len(MACHINES)):
        if at >= len(states):
            break
        for symbol in symbols:
            to = tuple(m.step(s, symbol) for m, s in zip(MACHINES, states[at]))
            if to not in states:
                states.append(to)
            arcs[at, symbol] = states.index(to)
    return arcs, states


def clause_class(state: tuple[int, ...]) -> int | None:
    insult, threat, target, negation, report = state
    threat = threat and target
    if not insult and not threat:
        return None
    if report:
        return 4
    if negation:
        return 3
    return 2 if threat else 1 if target else 0


ARCS, STATES = composed()
OUTCOME = [clause_class(s) for s in STATES]
STEM = range(3, 9)


def stems(token: str) -> set[str]:
    """What the lexicon may name a token by: its beginnings of 3 to 8 letters, and the whole token with an end mark."""
    return {token[:k] for k in STEM if len(token) >= k} | {f"{token}$"}


FUNCTION_WORDS = {w: kind for kind, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}


# Weight of an arc that reads a threat; arcs of insults weigh their learnt log odds, all others nothing.
THREAT_WEIGHT = 3.0


def arc_of(token: str, insults: dict[str, float]) -> tuple[str, float] | None:
    """The symbol that a token is to the machines, and the weight of reading it."""
    found = [insults[x] for x in stems(token) if x in insults]
    if found:
        return "insult", max(found)
    kind = FUNCTION_WORDS.get(token)
    return kind and (kind, THREAT_WEIGHT if kind == "threat" else 0.0)


def clause_weights(text: str, insults: dict[str, float], arcs: dict[str, tuple[str, float] | None] | None = None) -> np.ndarray:
    """Summed weight of the matched clauses of each class; a clause ends at a stop mark or line feed. ``arcs`` remembers
    tokens."""
    sums = np.zeros(len(CLASSES))
    arcs = {} if arcs is None else arcs
    if len(arcs) > 200_000:
        arcs.clear()
    state, weight = 0, 0.0
    for token in [*TOKEN.findall(text.lower()), "."]:
        if token in STOPS:
            if state and OUTCOME[state] is not None:
                sums[OUTCOME[state]] += weight
            state, weight = 0, 0.0
            continue
        try:
            arc = arcs[token]
        except KeyError:
            arc = arcs[token] = arc_of(token, insults)
        if arc:
            state = ARCS[state, arc[0]]
            weight += arc[1]
    return sums


def features(weights: np.ndarray) -> np.ndarray:
    """One for the bias, the weight of all matched clauses, and that of each class but bare insults, so that a class which
    training did not show counts like any match; each up to the weight of some four strong insults."""
    parts = [np.ones(weights.shape[:-1] + (1,)), weights.sum(axis=-1, keepdims=True) / 5.0, weights[..., 1:] / 5.0]
    return np.minimum(np.concatenate(parts, axis=-1), 4.0)


def score_text(grammar: Grammar, text: str | None, arcs: dict[str, tuple[str, float] | None] | None = None) -> float:
    x = features(clause_weights(text or "", grammar.insults, arcs))
    return float(1 / (1 + np.exp(-np.clip(x @ grammar.weights, -30, 30))))


def _stems_of(text: str) -> set[str]:
    return set().union(*(stems(t) for t in set(TOKEN.findall(text.lower())) if t not in STOPS))


def _words_by_label(sample: DataFrame) -> DataFrame:
    """(word, y, n): documents of each label that hold a word or stem, counted within each batch."""
    schema = pa.schema([("word", pa.string()), ("y", pa.int32()), ("n", pa.int64())])

    def task(batches):
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in _stems_of(text):
                    counts[w, y] = counts.get((w, y), 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return sample.mapInArrow(task, "word string, y int, n long")


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS, candidates: int = CANDIDATES, lexicon: int = LEXICON) -> Grammar:
    """Learn insults and class weights from at most ``rows`` rows with distinct texts, those with the smallest hash.

    Insults are words or stems, chosen one after the other: of the ``candidates`` most tied to toxic rows, the one that
    explains most toxic rows which no earlier one explains, as long as it is rare elsewhere, up to ``lexicon`` entries; the
    longest of equal ones. After that, entries that are common in toxic rows by themselves. Of rows that share the smallest
    hash of three words running (near copies) one is used, so that a passage copied often teaches no more than once. Weights come from a ridge logistic regression on the classes'
    weights. Rows without text or label teach nothing; without toxic or other rows the grammar gives 0.5 or less.
    """
    grammar = Grammar()
    text = F.col(text_col).cast("string")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    hashes = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    # Labels meet hashes, not texts; the rows chosen are at most ``rows`` short ones, and only their texts are fetched.
    chosen = ws.save(hashes.join(marks, "id").groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y")).orderBy("h").limit(rows))
    total = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    if len(total) < 2:
        return grammar
    usable = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["h", "id"]).select("text", "y")
    words_in = F.split(F.lower("text"), SPACE)
    sketch = let(words_in, lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 3), " ")))))
    near = usable.withColumn("sketch", sketch)
    sample = ws.save(near.groupBy("sketch", "y").agg(F.min("text").alias("text")).select("text", "y"))
    total = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return grammar
    by_word = _words_by_label(sample).groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    rate = F.col("p") / toxic - F.col("q") / clean
    tied = by_word.where(F.col("p") >= 3).where((F.col("p") + 0.5) / toxic > RATIO / 2 * (F.col("q") + 0.5) / clean).orderBy(rate.desc(), F.length("word").desc(), "word").limit(candidates)
    words = [r["word"] for r in tied.collect()]
    place = {w: i for i, w in enumerate(words)}

    def holds(batches):  # which candidates each row holds: at most ``rows`` short lists reach the driver
        for batch in batches:
            found = [sorted({place[t] for t in _stems_of(x) if t in place}) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "y"])

    lists = sample.mapInArrow(holds, "found array<int>, y int").where("size(found) > 0").collect()
    hit = {1: np.zeros((toxic, len(words)), bool), 0: np.zeros((clean, len(words)), bool)}
    seen = {0: 0, 1: 0}
    for r in lists:
        hit[r["y"]][seen[r["y"]], r["found"]] = True
        seen[r["y"]] += 1
    tied_to = hit[1].sum(axis=0)
    wrong = hit[0].sum(axis=0)
    sure = (tied_to + 0.5) / toxic > RATIO * (wrong + 0.5) / clean
    open_rows, free = np.ones(toxic, bool), sure.copy()
    while len(grammar.insults) < lexicon and free.any():
        gain = np.where(free, hit[1][open_rows].sum(axis=0), -1)
        best = int(gain.argmax())
        # Where no row is left to explain, a word still counts if it is common in toxic rows by itself.
        if gain[best] < max(3, 0.002 * toxic):
            best = int(np.where(free, tied_to, -1).argmax())
            if tied_to[best] < max(10, 0.02 * toxic):
                break
        word = words[best]
        grammar.insults[word] = float(np.log((tied_to[best] + 0.5) / toxic) - np.log((wrong[best] + 0.5) / clean))
        open_rows &= ~hit[1][:, best]
        free &= ~np.array([w.startswith(word) or word.rstrip("$").startswith(w.rstrip("$")) for w in words])
    insults = grammar.insults

    def counted(batches):
        for batch in batches:
            c = [(clause_weights(x, insults) * 2).round().astype(np.int64).tolist() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64())), batch.column(1)], names=["c", "y"])

    groups = sample.mapInArrow(counted, "c array<bigint>, y int").groupBy("c", "y").count().collect()
    grammar.weights = logistic(features(np.array([g["c"] for g in groups], float) / 2), np.array([g["y"] for g in groups], float), np.array([g["count"] for g in groups], float))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps; the bias is not held down."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(hold), x.T @ (n * (y - p)) - hold * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return w


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for likelier toxic, from the clauses of the whole text.

    Null and empty texts have no clause and so the score of the bias alone. Rows are judged one by one; an empty table
    gives an empty result, and a column named like the score is replaced.
    """
    rest = others(docs, (score_name,))
    plain = docs.select(*rest, F.col(text_col).cast("string").alias(unused("_text", docs)))

    def task(batches):
        arcs: dict[str, tuple[str, float] | None] = {}
        for batch in batches:
            found = [score_text(grammar, None if t is None else t.decode("utf-8", "replace"), arcs) for t in texts(batch.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + [pa.array(found, pa.float64())], names=[*rest, score_name])

    return plain.mapInArrow(task, StructType(plain.schema.fields[: len(rest)] + [StructField(score_name, DoubleType())]))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out("doc_id", 3, 1))
    grammar = fit(docs, labels, Workspace(spark))
    scored = score(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), grammar)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
