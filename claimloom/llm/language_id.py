"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimloom.llm.storage import Workspace, others, unused
from claimloom.llm.text import texts

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")
LONGEST = 5
# Bounds of what a model may be fitted on and may hold; all documented parameters of ``fit``.
TRAINING_ROWS = 8_000
KNOWN_WORDS = 50_000
KNOWN_GRAMS = 100_000
UNKNOWN = "und"


@dataclass
class Model:
    """Log frequency of known words and of n-grams of 1 to LONGEST characters, one row per language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    floor: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        """Of a known word its log frequencies; else the mean over the longest n-grams of it that are known, those
        that still are not known being looked up one character shorter."""
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        return self._by_grams(f"<{word}>", LONGEST)

    def _by_grams(self, marked: str, size: int) -> np.ndarray:
        size = min(size, len(marked))
        total, count = np.zeros(len(self.languages)), 0
        for i in range(len(marked) - size + 1):
            for n in range(size, 0, -1):
                at = self.grams.get(marked[i : i + n])
                if at is not None:
                    total += self.gram_logs[at]
                    break
            else:
                total += self.floor
            count += 1
        return total / max(1, count)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(rows: DataFrame) -> DataFrame:
    """(lang, kind, token, n): words (kind 0) and n-grams of marked words (1), counted within each batch."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("token", pa.string()), ("n", pa.int64())])

    def task(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in words_of(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            grams: dict[tuple[str, str], int] = {}
            for (lang, w), n in counts.items():
                marked = f"<{w}>"
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        g = lang, marked[i : i + size]
                        grams[g] = grams.get(g, 0) + n
            for kind, table in ((0, counts), (1, grams)):
                if table:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k[0] for k in table]), pa.array([kind] * len(table), pa.int32()), pa.array([k[1] for k in table]), pa.array(list(table.values()), pa.int64()),
                    ], schema=schema)

    return rows.mapInArrow(task, "lang string, kind int, token string, n long")


def fit(
    labelled: DataFrame, ws: Workspace, text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS, words: int = KNOWN_WORDS, grams: int = KNOWN_GRAMS
) -> Model:
    """A model of at most ``words`` words and ``grams`` n-grams from at most ``rows`` labelled rows with distinct texts, those
    with the smallest hash, so the same ones at every partitioning. A text teaches once per language, however often it is
    repeated. Rows without text or language teach nothing."""
    text = F.col(text_col).cast("string")
    usable = labelled.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # The text itself is fetched only for rows below the rank's hash.
    ranked = usable.select(F.xxhash64("text", "lang").alias("h")).distinct().orderBy("h").limit(rows)
    bound = ranked.agg(F.max("h")).first()[0]
    if bound is None:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    chosen = usable.withColumn("h", F.xxhash64("text", "lang")).where(F.col("h") <= bound)
    sample = chosen.groupBy("h").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "row.text")
    tokens = ws.save(_tokens(sample).groupBy("kind", "token", "lang").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in tokens.select("lang").distinct().orderBy("lang").collect()]
    counted = tokens.groupBy("kind", "token").pivot("lang", languages).agg(F.sum("n")).fillna(0)
    total = sum(F.col(f"`{c}`") for c in languages)
    logs = []
    tables = []
    for kind, most in ((0, words), (1, grams)):
        got = counted.where(F.col("kind") == kind).where(total > 1).orderBy(total.desc(), "token").limit(most).toPandas()
        counts = got[languages].to_numpy(float) if len(got) else np.zeros((0, len(languages)))
        tables.append({t: i for i, t in enumerate(got["token"])})
        logs.append((np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * (len(got) + 1))).astype(np.float64) if len(got) else counts)
    ws.drop(tokens)
    floor = np.log(0.5) - np.log(np.exp(logs[1]).sum(axis=0) + 1) if len(logs[1]) else np.zeros(len(languages))
    floor = np.minimum(floor, logs[1].min(axis=0) if len(logs[1]) else 0)
    return Model(list(languages), tables[0], logs[0], tables[1], logs[1], floor)


def identify_text(model: Model, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
    """The likeliest language of the whole text and its probability; ``und`` and 0 for null or no letter."""
    if text is None or not LETTER.search(text) or not model.languages:
        return UNKNOWN, 0.0
    found = words_of(text)
    if not found:
        return UNKNOWN, 0.0
    total = np.zeros(len(model.languages))
    rows = []
    for w in found:
        at = model.words.get(w)
        if at is not None:
            rows.append(at)
            continue
        logs = cache.get(w)
        if logs is None:
            if len(cache) >= 50_000:
                cache.clear()
            logs = cache[w] = model.of_word(w)
        total += logs
    if rows:
        total += model.word_logs[rows].sum(axis=0)
    total -= total.max()
    odds = np.exp(total)
    best = int(odds.argmax())
    return model.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0, as all are if the model learnt
    from nothing; ties go to the language first in order. Rows are judged one by one, so repeated rows get equal results
    and an empty table an empty one. Columns of ``docs`` with the two names are replaced.
    """
    rest = others(docs, (lang_name, score_name))
    plain = docs.select(*rest, F.col(text_col).cast("string").alias(unused("_text", docs)))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # of at most KNOWN_WORDS and KNOWN_GRAMS entries

    def task(batches):
        known, cache = Model(**shared.value), {}
        for batch in batches:
            found = [identify_text(known, None if t is None else t.decode("utf-8", "replace"), cache) for t in texts(batch.column(len(rest)))]
            arrays = [batch.column(i) for i in range(len(rest))] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, lang_name, score_name])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return plain.mapInArrow(task, StructType(plain.schema.fields[: len(rest)] + [StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id", 4, 2)), Workspace(spark))
    return identify(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
