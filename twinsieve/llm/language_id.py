"""Operator 1: language identification.

A text is the average of the embeddings of its hashed subwords (letter n-grams with word bounds), put through a linear
softmax. Embeddings and weights are trained together in numpy by stochastic gradient descent on the counts of all
subwords of the whole texts of a bounded sample of labelled rows; probabilities are calibrated by a temperature fitted on a part of it, and a prediction whose calibrated
probability is under one half is rejected: it would be wrong more often than right.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, in_batches, kept, table

UNKNOWN = "und"
BUCKETS, ORDERS, DIMENSIONS = 1 << 16, (1, 2, 3, 4), 16
#: Languages that a model knows at most, the most frequent of the sample's table.
LANGUAGES = 1024
#: Code points handled at once, so that memory doesn't grow with a text.
PART = 1 << 20


@dataclass
class Model:
    """languages; scores: for each bucket its part of the logits; offset; temperature; threshold."""

    languages: list[str]
    scores: np.ndarray
    offset: np.ndarray
    temperature: float
    threshold: float


def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, "u4")
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def subwords(text: str, lower: np.ndarray, overlap: int = max(ORDERS)) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text, part by part; none if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for start in range(0, len(points), PART):
        part = lower[points[start : start + PART + overlap]]
        part = np.concatenate([[0], part, [0]]).astype("u8")
        part = part[np.concatenate([[True], (part[1:] != 0) | (part[:-1] != 0)])]
        if len(part) < 3:
            continue
        hashed, found = np.zeros(len(part), "u8"), []
        for n in range(1, max(ORDERS) + 1):
            last = len(part) - n + 1
            if last <= 0:
                break
            hashed = hashed[:last] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                mixed = hashed * np.uint64(0x9E3779B97F4A7C15)
                got = (mixed >> np.uint64(48)).astype("i8") % BUCKETS
                found.append(got[part[:last] != 0] if n == 1 else got)
        yield np.concatenate(found)


def counted(text: str | None, lower: np.ndarray) -> np.ndarray:
    """(bucket, how often) of all n-grams of the whole text, by bucket."""
    total = np.zeros(BUCKETS, "i8")
    for found in subwords(text or "", lower):
        total += np.bincount(found, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return np.stack([used, total[used]], 1)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, rate: float = 1.0, batch: int = 64, seed: int = 7) -> Model | None:
    """A model of (n-gram buckets, their counts), language rows; None without any row. The last fifth of a shuffle calibrates.

    Rows stay as they came, which may be in two and four bytes; only a batch at a time is turned into shares.
    """
    rows = [(*f, y) for f, y in zip(features, labels, strict=True) if len(f[0])]
    if not rows:
        return None
    languages = sorted({y for _, _, y in rows})
    number = {y: k for k, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) * 4 // 5)
    fitted, held = order[:cut], order[cut:] if cut < len(rows) else order[:cut]
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype("f4")
    weights, offset = np.zeros((DIMENSIONS, len(languages)), "f4"), np.zeros(len(languages), "f4")
    epochs = max(epochs, -(-400 // -(-len(fitted) // batch)))  # a small table takes more turns
    steps, done = epochs * (-(-len(fitted) // batch)), 0
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(fitted), -(-len(fitted) // batch)):
            ids = np.concatenate([rows[k][0] for k in chunk]).astype("i8")
            seen = np.zeros(BUCKETS, bool)
            seen[ids] = True
            used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[ids]
            doc = np.repeat(np.arange(len(chunk)), [len(rows[k][0]) for k in chunk])
            share = np.zeros((len(chunk), len(used)), "f4")
            share[doc, place] = np.concatenate([_shares(rows[k][1]) for k in chunk])
            vectors = share @ table_[used]
            p = _softmax(vectors @ weights + offset)
            p[np.arange(len(chunk)), [number[rows[k][2]] for k in chunk]] -= 1
            p /= len(chunk)
            now = rate * (1 - done / steps)
            table_[used] -= now * len(chunk) * (share.T @ (p @ weights.T))
            weights -= now * (vectors.T @ p)
            offset -= now * p.sum(0)
            done += 1
    scores = (table_ @ weights).astype("f4")
    logits = np.array([_shares(rows[k][1]) @ scores[rows[k][0]] + offset for k in held])
    truth = np.array([number[rows[k][2]] for k in held])
    loss = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 61)}
    return Model(languages, scores, offset.astype("f8"), float(min(loss, key=loss.get)), 0.5)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum(dtype="i8")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(df: DataFrame, label: Column, most: int, id_col: str) -> DataFrame:
    """About `most` rows in equal parts of each label (all rows of a rare one), chosen by a hash of the id.

    Rows of the LANGUAGES most frequent labels, ties to the lesser, so that what the driver gets is bounded.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label.alias("label")).count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    if not counts:
        return df.limit(0)
    each = most / len(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    return df.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 20)) < F.try_element_at(share, label) * (1 << 20))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 6000) -> Model | None:
    """Train on at most about `most` rows of df with a language, equally many of each language where it has them.

    All n-grams of those whole texts count; of each text its at most BUCKETS counts come to the driver.
    """
    rows = sample(df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("label")), F.col("label"), most, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = kept("letters", letters)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found = counted(text, lower)
                out.append(found[:, 0].astype("u2").tobytes() + found[:, 1].astype("u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["ids", "label"])

    got = rows.select("text", "label").transform(in_batches, run, "ids binary, label string").toArrow()
    # sorted, so that the model doesn't depend on the order in which tasks end
    pairs = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    del got
    give_back(df.sparkSession)
    try:
        return fit([unpacked(x) for _, x in pairs], [y for y, _ in pairs])
    finally:  # the driver holds nothing of the training through what follows
        del pairs
        give_back()


def unpacked(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts, as views of six bytes for each bucket: all buckets, then all counts."""
    n = len(counts) // 6
    return np.frombuffer(counts, "u2", n), np.frombuffer(counts, "u4", n, 2 * n)


def judge(text: str | None, model: Model | None, lower: np.ndarray) -> tuple[str, float]:
    """Language and calibrated probability of one whole text."""
    if not text or model is None:
        return UNKNOWN, 0.0
    n, total, most = 0, np.zeros(len(model.languages)), max(1, PART // len(model.languages))
    for found in subwords(text, lower):
        n += len(found)
        for k in range(0, len(found), most):
            some = found[k : k + most]
            total += np.ones(len(some)) @ model.scores.take(some, 0).astype("f8")
    if not n:
        return UNKNOWN, 0.0
    p = _softmax((total / n + model.offset) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, accepted of each row, from its whole text alone.

    A null text or one without a letter gets `und`, score 0 and is not accepted; without a model every text does.
    Rows are judged one by one, so repeated ones get the same result. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a float for each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, m = kept("letters", letters), shared.value
        for batch in batches:
            names, scores, accepted = [], [], []
            for text in batch.column(1).to_pylist():
                name, score = judge(text, m, lower)
                names.append(name)
                scores.append(score)
                accepted.append(name != UNKNOWN and score >= m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is recognised, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, m = kept("letters", letters), shared.value
        for batch in batches:
            found = [judge(t, m, lower) for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            keep = [name != UNKNOWN and score >= m.threshold for name, score in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_batches, run, docs.schema)
