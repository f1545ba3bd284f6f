"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

A text's features are its hashed character n-grams (1 to 4 code points, lower case, whole text),
damped and scaled to unit length. The training rows' languages fall into families by
``FAMILIES`` (a language it doesn't know is a family of its own). One linear support vector machine
separates each pair of families, and one each pair of languages of a family. A text goes to the
family, then to that family's language, with the best mean chance over its pairs; the score is the
product of the two chances.

The machines are fitted on the driver, on a sample of at most ``SAMPLE`` labelled training rows,
dealt evenly to the languages and chosen by a hash of the id; of more languages than that, the most
frequent ones are learned. This bound is the only one: every text is predicted, whole.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, and so is every
text if nothing can be learned; with one language that is predicted with score 1. A null id is not
held out and not learned from; repeated rows are predicted each; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Sent, bounded_batches, table, training_row

UNKNOWN, DIMENSIONS, ORDERS, SAMPLE = "und", 1 << 13, 4, 2400
MODULUS, HELD = 4, 2

#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages.split()}


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Unit vector of damped n-gram counts, then a constant for the bias."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(DIMENSIONS)
    grams = np.zeros(len(points), np.uint64)
    for order in range(min(ORDERS, len(points))):
        grams = (grams[: len(points) - order] * np.uint64(1_000_003)) ^ points[order:] if order else points
        slot = ((grams + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
        counts += np.bincount(slot.astype(np.int64), minlength=DIMENSIONS)
    counts = np.log1p(counts)
    return np.r_[counts / np.linalg.norm(counts), 1.0].astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; y is -1 or 1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    norm = (x * x).sum(axis=1)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(w @ x[i]) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Machines:
    """One-versus-one machines between some names."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.names)), 2))
        which = np.array([self.names.index(name) for name in labels])
        weights = []
        for i, j in self.pairs:
            both = (which == i) | (which == j)
            weights.append(fit_svm(x[both], np.where(which[both] == i, 1.0, -1.0)))
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), x.shape[1])

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Rows of the mean chance of each name over its pairs."""
        if len(self.names) == 1:
            return np.ones((len(x), 1))
        out = np.zeros((len(x), len(self.names)))
        won = 1 / (1 + np.exp(-np.clip(3.0 * (x @ self.weights.T), -30, 30)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += won[:, k]
            out[:, j] += 1 - won[:, k]
        return out / (len(self.names) - 1)


class Hierarchy:
    def __init__(self, x: np.ndarray, languages: list[str]):
        families = [FAMILY.get(name, name) for name in languages]
        self.top = Machines(x, families)
        self.within = []
        for family in self.top.names:
            mine = [i for i, f in enumerate(families) if f == family]
            self.within.append(Machines(x[mine], [languages[i] for i in mine]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        x = np.stack([features(t) for t in texts])
        family = self.top.chances(x)
        first, names, scores = family.argmax(axis=1), [""] * len(texts), np.zeros(len(texts))
        for f in np.unique(first).tolist():
            rows = np.flatnonzero(first == f)
            chance = self.within[f].chances(x[rows])
            best = chance.argmax(axis=1)
            for row, b in zip(rows.tolist(), best.tolist(), strict=True):
                names[row] = self.within[f].names[b]
            scores[rows] = family[rows, f] * chance[np.arange(len(rows)), best]
        return names, scores.tolist()


def sample(rows: DataFrame) -> DataFrame:
    """At most SAMPLE rows (lang, text), as many of each language as there are, those with the smallest hash of their id."""
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    each = max(1, SAMPLE // max(1, len(counts)))
    place = F.pmod(F.xxhash64("doc_id"), 1 << 30)
    # A first cut that keeps about twice as many as needed, so that only these texts are moved.
    likely = F.lit(False)
    for lang, n in counts.items():
        likely = likely | ((F.col("lang") == lang) & (place < int(min(1.0, (2 * each + 50) / n) * (1 << 30))))
    first = F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id"))
    return rows.where(likely).withColumn("_first", first).where(F.col("_first") <= each).select("lang", "text")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Hierarchy | None:
    """Learn from the training rows of ``docs``."""
    learned = training_row(doc_id, MODULUS, HELD)[1]
    rows = docs.where(learned & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = features(body)
                on = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([on.astype("<u2").tobytes() + x[on].tobytes()])], names=["lang", "x"])

    got = sorted(map(tuple, sample(rows).mapInArrow(vectors, "lang string, x binary").collect()))
    if not got:
        return None
    x = np.zeros((len(got), DIMENSIONS + 1), np.float32)
    for i, (_, data) in enumerate(got):
        n = len(data) // 6
        x[i, np.frombuffer(data[: 2 * n], "<u2")] = np.frombuffer(data[2 * n :], np.float32)
    return Hierarchy(x, [name for name, _ in got])


def predictor(spark: SparkSession, model: Hierarchy | None):
    """A function from texts to (languages, scores) that runs on executors."""
    bounded_batches(spark)
    sent = Sent(spark, model)

    def predict(bodies: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(bodies), [0.0] * len(bodies)
        if sent.value is not None:
            told = [i for i, body in enumerate(bodies) if has_letter(body)]
            for at in range(0, len(told), 256):
                block = told[at : at + 256]
                for i, name, score in zip(block, *sent.value.predict([bodies[i] for i in block]), strict=True):
                    names[i], scores[i] = name, score
        return names, scores

    return predict


def identify(docs: DataFrame, model: Hierarchy | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score."""
    predict = predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = training_row(doc_id, MODULUS, HELD)[0]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are in some language; those that are ``und`` go.

    If there is nothing to learn languages from, only texts without letters go.
    """
    model = train(docs, doc_id, text, lang)
    if model is None:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != UNKNOWN for name in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
