"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Each document has statistics of its text alone; each statistic goes through ramps between quantiles of the training
sample, so outliers count no more than the ends. A pair is a document labelled 1 and one labelled 0; the score's
weights minimise the logistic loss on the pairs' feature differences, by Newton steps on the driver over a bounded
sample (`MAX_LABELLED` labelled documents, taken by the hash of their ids, and `MAX_PAIRS` pairs). The threshold is
a quantile of the sample's scores: the one that agrees with most labels. The result is the logistic
function of the score less the threshold, so 0.5 is the threshold.

How much of a text repeats is measured in blocks of `WORDS` words, so a text of any length is read a stretch at a time.

Defined cases: a null text counts as empty, and both get the score of their statistics; null labels and labels of
documents that are absent are ignored; an id that is labelled both ways counts once for each; of several documents with one labelled id the
one whose statistics hash least is learnt from; with labels of one kind only, or none, all scores are 0.5; repeated rows are scored row by
row; other columns are kept by `keep_good`; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact

MAX_LABELLED, MAX_PAIRS = 20_000, 30_000
_KNOTS = (0.0, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 1.0)


def _classes() -> np.ndarray:
    """Byte classes, a column each."""
    sets = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)], b"#$%&*@^~|<>=+\\", b"!?", b".", b",;:", b"|", b"\n", b"/_-", range(0x20)]
    out = np.zeros((256, len(sets)))
    for i, s in enumerate(sets):
        out[list(s), i] = 1
    return out


_CLASSES = _classes()


#: Words of a block in which repetition is measured.
WORDS = 1024
#: What is summed over a text: bytes by value, then words, short, long and marked words, words that end in a symbol; words and pairs of neighbours that are new in their block, pairs.
_SUMS = 256 + 8


def _repetition(doc: np.ndarray, place: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each document: distinct words of each block, distinct pairs of neighbours in a block, and pairs, summed over its blocks."""
    block = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (place[1:] % WORDS == 0)))).astype(np.uint64)[: len(doc)]

    def distinct(block, doc, hashes):
        _, first = np.unique((block << np.uint64(40)) | (hashes >> np.uint64(24)), return_index=True)
        return np.bincount(doc[first], minlength=n)

    same = block[1:] == block[:-1]
    pairs = _kernel.mix(_kernel.join(hashes[:-1], hashes[1:]))[same]
    return np.stack([distinct(block, doc, hashes), distinct(block[1:][same], doc[1:][same], pairs), np.bincount(doc[1:][same], minlength=n)], 1)


def _word_sums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    length, last = end - start, buf[end - 1]
    return np.stack([np.bincount(doc, x, n) for x in (np.ones(len(doc)), length < 4, length > 12, _CLASSES[last, 4] > 0, _CLASSES[last, 5] > 0)], 1)


def _long_sums(text: np.ndarray) -> np.ndarray:
    """The sums of one long text."""
    out, held, done = np.zeros(_SUMS), np.empty(0, np.uint64), 0
    for _, start, end, at, stop in _kernel.stretches(text, _kernel.WHITE, 0):
        buf = text[at:stop]
        out[:256] += np.bincount(buf, minlength=256)
        if len(start):
            out[256:261] += _word_sums(buf, start, end, np.zeros(len(start), np.int64), 1)[0]
            held = np.concatenate([held, _kernel.word_hashes(buf, start, end)])
        whole = len(held) if stop == len(text) else len(held) // WORDS * WORDS
        if whole:
            out[261:] += _repetition(np.zeros(whole, np.int64), np.arange(whole), held[:whole], 1)[0]
            held, done = held[whole:], done + whole
    return out


def statistics(texts) -> np.ndarray:
    """A row of numbers for each text."""
    whole, offsets = _kernel.pack(texts)
    sums, last = np.zeros((len(offsets) - 1, _SUMS)), np.zeros(len(offsets) - 1)
    for a, b in _kernel.parts(offsets):
        buf, at = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a == 1 and len(buf) > _kernel.PIECE:
            sums[a] = _long_sums(buf)
        else:
            sums[a:b, :256] = [np.bincount(buf[x:y], minlength=256) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            start, end, first = _kernel.words(buf, at, _kernel.WHITE)
            if len(start):
                doc, place = _kernel.ragged(np.diff(first))
                sums[a:b, 256:261] = _word_sums(buf, start, end, doc, b - a)
                sums[a:b, 261:] = _repetition(doc, place, _kernel.word_hashes(buf, start, end), b - a)
        full = np.flatnonzero(np.diff(at) > 0)
        last[a + full] = np.isin(buf[at[1:][full] - 1], np.frombuffer(b".!?", np.uint8))
    size, (count, short, long, marked, symbol, distinct, new_pairs, pairs) = np.diff(offsets), sums[:, 256:].T
    words, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    return np.column_stack([np.log1p(size), np.log1p(count), size / words, distinct / words, new_pairs / np.maximum(pairs, 1), short / words, long / words, marked / words, symbol / words, last, sums[:, :256] @ _CLASSES / bytes_[:, None]])


@dataclass
class Model:
    """knots: for each statistic its distinct quantiles; weights: one for each ramp between two."""

    knots: list[np.ndarray]
    weights: np.ndarray
    threshold: float

    def ramps(self, x: np.ndarray) -> np.ndarray:
        out = [np.clip((x[:, i, None] - k[None, :-1]) / np.diff(k), 0, 1) for i, k in enumerate(self.knots) if len(k) > 1]
        return np.concatenate(out, 1) if out else np.zeros((len(x), 0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ramps(x) @ self.weights - self.threshold, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, pairs: int = MAX_PAIRS, seed: int = 11, penalty: float = 1e-3) -> Model:
    """x: statistics, y: labels 0 or 1."""
    knots = [np.unique(np.quantile(x[:, i], _KNOTS)) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    model = Model(knots, np.zeros(sum(max(0, len(k) - 1) for k in knots)), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    ramps, rng = model.ramps(x), np.random.default_rng(seed)
    differences = ramps[rng.choice(good, pairs)] - ramps[rng.choice(bad, pairs)]
    w = model.weights
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -500, 500)))  # chance that the pair is lost
        gradient = -(differences.T @ p) / pairs + penalty * w
        curvature = (differences.T * (p * (1 - p))) @ differences / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w
    scores = ramps @ w
    order = np.argsort(scores, kind="stable")
    right = np.concatenate(([0], np.cumsum(y[order] == 0))) + np.concatenate((np.cumsum((y[order] == 1)[::-1])[::-1], [0]))  # labels met with so many documents below
    below = int(np.argmax(right))
    edges = np.concatenate(([scores[order[0]] - 1], scores[order], [scores[order[-1]] + 1]))
    model.threshold = float((edges[below] + edges[below + 1]) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents that aren't held out: those whose crc32(id as text) modulo 3 isn't 1."""
    chosen = labels.where(exact(label_col).isin(0, 1) & ~held_out(exact(id_col))).select(exact(id_col).cast("long").alias("id"), exact(label_col).cast("int").alias("y")).dropDuplicates()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_LABELLED)
    rows = docs.select(exact(id_col).cast("long").alias("id"), exact(text_col).alias("text")).join(F.broadcast(chosen), "id")  # MAX_LABELLED pairs of numbers

    def measure(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])
            _kernel.release()

    measured = rows.select("id", "text", "y").mapInArrow(measure, "id long, y int, x array<double>")
    got = measured.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x"))["x"].alias("x")).toPandas()  # at most MAX_LABELLED rows
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, statistics(pa.array([""])).shape[1]))
    order = np.lexsort((got["y"].to_numpy(), got["id"].to_numpy()))  # the same at every run
    return train(x[order], got["y"].to_numpy(np.int64)[order])


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(statistics(pa.array(texts, pa.string(), from_pandas=True))))

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1."""
    return docs.withColumn(name, _scorer(model)(exact(text_col)))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of 0.5 or more, columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = model.scores(statistics(batch.column(at))) >= 0.5
            yield batch.filter(pa.array(keep, pa.bool_()))
            _kernel.release()

    return docs.mapInArrow(run, docs.schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op9: every document's score and class."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            s = model.scores(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
            _kernel.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
