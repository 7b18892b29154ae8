"""Operator 9: toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words, hashed into buckets. Its score is a sigmoid of an offset, a weight for each
term and, for each pair of terms, the inner product of their factors, so that two terms which are harmless alone can
count together. All terms of the sample are trained, rare ones too: weights by adaptive gradient steps under a lasso,
then factors with them under a group lasso, so that uninformative terms come to nought by themselves. Factors start from
the leading eigenvectors of the terms' co-occurrence in what the weights alone leave unexplained: near nought the loss
is flat in them, and gradient steps would not find a pair that tells nothing by its single terms. Rows kept aside
decide how strong the group lasso is and when to stop, and calibrate by a logistic fit.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, give_back, held_out, in_batches, table, word_runs

THRESHOLD = 0.7
FACTORS = 6
#: Buckets that terms are hashed into: the bound of a model's size.
BUCKETS = 1 << 18
#: The lasso is adaptive: a term whose rows' share of toxic ones is further off chance than so many standard deviations is
#: held down less.
CLEAR = 3.0
#: Strengths of the group lasso, in standard deviations of a gradient under chance; the next is tried if pairs help.
PAIRS = (1.0, 0.5)

@dataclass
class Model:
    """terms: sorted buckets that have a weight or factors; their weights and factors; offset; scale and shift of the calibration."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    offset: float
    scale: float
    shift: float


def term_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def words(text: str | None) -> set[str]:
    return set(word_runs(text)) if text else set()


def logits(model: Model, places: np.ndarray) -> float:
    """The logit of one text, whose terms stand at `places` of the model."""
    v = model.factors[places]
    return model.offset + model.weights[places].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())


def probability(model: Model, places: np.ndarray) -> float:
    z = model.scale * logits(model, places) + model.shift
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _by_row(x: np.ndarray, ends: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Sums, of the kind of x or the given one, of x[ends[k] : ends[k + 1]]; noughts for an empty stretch."""
    out = np.zeros((len(ends) - 1, *x.shape[1:]), kind or x.dtype)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, ends[some], 0, out.dtype)
    return out


def _summed(table: np.ndarray, at: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Sums of table[at[ends[k] : ends[k + 1]]], of which about `most` rows are gathered at a time."""
    out, k = np.zeros((len(ends) - 1, table.shape[1]), table.dtype), 0
    while k < len(ends) - 1:
        j = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
        out[k:j] = _by_row(table[at[ends[k] : ends[j]]], ends[k : j + 1] - ends[k])
        k = j
    return out


class _Rows:
    """Rows of terms, one after another, for sums over rows and over terms; four bytes for each term of a row."""

    def __init__(self, places: np.ndarray, ends: np.ndarray, rows: np.ndarray):
        sizes = ends[rows + 1] - ends[rows]
        self.n, self.ends = len(rows), np.concatenate([[0], np.cumsum(sizes)])
        self.at = np.empty(self.ends[-1], "i4")
        for k, row in enumerate(rows):
            self.at[self.ends[k] : self.ends[k + 1]] = places[ends[row] : ends[row + 1]]

    @property
    def doc(self) -> np.ndarray:
        """The row of each term."""
        return np.repeat(np.arange(self.n, dtype="i4"), np.diff(self.ends))

    def numbered(self, terms: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms that the rows have, and `at` as places among those."""
        number = np.zeros(terms, "i4")
        number[self.at] = 1
        used = np.flatnonzero(number)
        number[used] = np.arange(len(used))
        return used, number[self.at]

    def counts(self, n: int, rows: int = 512) -> np.ndarray:
        """For each of n terms how many rows have it; some rows at a time."""
        out = np.zeros(n, "i8")
        for k in range(0, self.n, rows):
            out += np.bincount(self.at[self.ends[k] : self.ends[min(k + rows, self.n)]], minlength=n)
        return out

    def by_term(self, n: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each of n terms, in order, one term after another, and where each term's end; some rows at a time."""
        ends = np.concatenate([[0], np.cumsum(self.counts(n))])
        out, free = np.empty(len(self.at), "i4"), ends[:-1].copy()
        for k in range(0, self.n, rows):
            upto = self.ends[k : k + rows + 1]
            at = self.at[upto[0] : upto[-1]]
            order = np.argsort(at, kind="stable")
            at = at[order]
            out[free[at] + np.arange(len(at)) - np.searchsorted(at, at)] = np.repeat(np.arange(k, k + len(upto) - 1, dtype="i4"), np.diff(upto))[order]
            free += np.bincount(at, minlength=n)
        return out, ends

    def over_terms(self, x: np.ndarray) -> np.ndarray:
        """For each row the sum of x, a table of terms, over its terms."""
        return _summed(x, self.at, self.ends)

    def over_rows(self, x: np.ndarray, n: int, rows: int = 512) -> np.ndarray:
        """For each of n terms the sum of x, a number for each row, over its rows; some rows at a time."""
        out = np.zeros(n)
        for k in range(0, self.n, rows):
            ends = self.ends[k : k + rows + 1]
            out += np.bincount(self.at[ends[0] : ends[-1]], np.repeat(x[k : k + rows], np.diff(ends)), n)
        return out


def _by_place(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, x[:, f], n) for f in range(x.shape[1])], 1)


@dataclass
class _State:
    """What is trained, and the squared gradients so far."""

    offset: float
    weights: np.ndarray
    factors: np.ndarray
    seen_w: np.ndarray
    seen_v: np.ndarray
    paired: bool = False

    def copy(self) -> _State:
        return _State(self.offset, self.weights.copy(), self.factors.copy(), self.seen_w.copy(), self.seen_v.copy(), self.paired)

    def logits(self, r: _Rows, used: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Logits of numbered rows, and the factors of their terms summed up by row; no factors count until paired."""
        z = self.offset + _summed(self.weights[used, None], at, r.ends)[:, 0]
        if not self.paired:
            return z, None
        v = self.factors[used]
        sums = _summed(v, at, r.ends)
        return z + 0.5 * ((sums**2).sum(1) - _summed((v**2).sum(1, keepdims=True), at, r.ends)[:, 0]), sums

    def judged(self, r: _Rows) -> np.ndarray:
        """Logits of rows."""
        return self.logits(r, *r.numbered(len(self.weights)))[0]

    def loss(self, r: _Rows, y: np.ndarray) -> float:
        z = self.judged(r)
        return float((np.logaddexp(0, z) - y * z).mean())

    def step(self, r: _Rows, y: np.ndarray, rate: float, lasso: np.ndarray, group: np.ndarray | None) -> None:
        """One adaptive gradient step with its proximal step; without `group` factors stay."""
        (used, at), doc = r.numbered(len(self.weights)), r.doc
        z, sums = self.logits(r, used, at)
        g = (_sigmoid(z) - y) / r.n
        self.offset -= 0.5 * rate * float(g.sum())
        grad = np.bincount(at, g[doc], len(used))
        self.seen_w[used] += grad**2
        step = rate / np.sqrt(self.seen_w[used])
        w = self.weights[used] - step * grad
        self.weights[used] = np.sign(w) * np.maximum(0, np.abs(w) - step * lasso[used])
        if group is not None:
            grad = _by_place(at, g[doc, None] * (sums[doc] - self.factors[r.at]), len(used))
            self.seen_v[used] += grad**2
            step = 0.3 * rate / np.sqrt(self.seen_v[used] + 1e-6)
            x = self.factors[used] - step * grad
            norm = np.sqrt((x**2).sum(1, keepdims=True)) + 1e-12
            self.factors[used] = x * np.maximum(0, 1 - step.mean(1, keepdims=True) * group[used, None] / norm)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _leading(r: _Rows, rest: np.ndarray, often: np.ndarray, rng: np.random.Generator, turns: int = 10) -> np.ndarray:
    """A start for the factors of all terms: leading eigenvectors of their co-occurrence weighted by `rest`.

    Found by subspace iteration, without the matrix: its products are sums over rows and terms. often: each term's share
    of rows, by which the matrix is scaled so that neither frequent nor single terms rule it.
    """
    terms = len(often)
    doc, ends = r.by_term(terms)
    scale = (1 / np.sqrt(often + 0.05)).astype("f4")
    diagonal = r.over_rows(rest, terms) / r.n * scale**2
    base = np.linalg.qr(rng.normal(size=(terms, min(terms, FACTORS + 2))))[0]
    for _ in range(turns):
        sums = r.over_terms(base.astype("f4") * scale[:, None]) * rest.astype("f4")[:, None]
        image = _summed(sums, doc, ends) / r.n * scale[:, None] - diagonal[:, None] * base
        small, held = base.T @ image, base
        base = np.linalg.qr(image)[0]
    values, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:FACTORS]
    vectors = held @ turn[:, top]
    vectors = np.sign(vectors) * np.maximum(0, np.abs(vectors) - 1.5 / np.sqrt(terms))
    out = np.zeros((terms, FACTORS))
    out[:, : len(top)] = vectors * scale[:, None] * np.sqrt(np.maximum(0, values[top] - np.abs(values[top]).min()))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, lasso: float = 6.0, patience: int = 6, seed: int = 11) -> Model:
    """A model of (distinct term buckets, 0 or 1) rows. Without rows of both labels it scores every text alike.

    The list of rows is emptied, to hold their terms once.
    """
    share = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    none = Model(np.zeros(0, "i8"), np.zeros(0, "f4"), np.zeros((0, FACTORS), "f4"), base, 1.0, 0.0)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("i8")
    if len(set(labels.tolist())) < 2 or not ends[-1]:
        return none
    places = np.concatenate(rows).astype("i4", copy=False)
    rows.clear()  # the caller's, too: each term of a row takes four bytes from here on
    have = np.zeros(BUCKETS, bool)
    have[places] = True
    terms, places = np.flatnonzero(have), (np.cumsum(have, dtype="i4") - 1)[places]
    y, rng = labels.astype("f8"), np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    fitted, held = order[:cut], order[cut:]
    if len(set(labels[held].tolist())) < 2:
        fitted = held = order
    whole, aside = _Rows(places, ends, fitted), _Rows(places, ends, held)
    often = whole.counts(len(terms)) / len(fitted)
    # what a term's gradient is by chance, in the batches that have the term: only there a penalty counts
    chance = np.sqrt(share * (1 - share) / len(fitted)) * np.maximum(np.sqrt(often * (1 - often)), 1e-6)
    tells = np.abs(whole.over_rows(y[fitted] - share, len(terms))) / len(fitted) / chance
    adapted = lasso * np.minimum(1, (CLEAR / np.maximum(tells, 1e-9)) ** 2)
    chance /= 1 - (1 - np.clip(often, 1 / len(fitted), 1 - 1e-9)) ** batch

    def epoch(state: _State, turn: int, group: np.ndarray | None) -> None:
        """Every fourth takes all terms; between them, those at nought, which change nothing, are left out."""
        at, upto = places, ends
        if turn % 4:
            live = ((state.weights != 0) | (state.factors != 0).any(1))[places]
            at, upto = places[live], np.concatenate([[0], np.cumsum(_by_row(live, ends, "i8"))])
        for chunk in np.array_split(rng.permutation(fitted), -(-len(fitted) // batch)):
            state.step(_Rows(at, upto, chunk), y[chunk], rate, adapted * chance, group)

    linear = _State(base, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)), share * (1 - share) * often / batch + 1e-8, np.zeros((len(terms), FACTORS)))
    for turn in range(epochs):
        epoch(linear, turn, None)
    best, least = linear, linear.loss(aside, y[held])
    start = _leading(whole, y[fitted] - _sigmoid(linear.judged(whole)), often, rng)
    for strength in PAIRS:
        before, state = least, linear.copy()
        state.paired, state.factors = True, start.copy()
        state.seen_v = np.repeat((share * (1 - share) * np.maximum(often, 1 / len(fitted)) / batch)[:, None], FACTORS, 1)
        mine, idle = np.inf, 0
        for turn in range(1, 3 * epochs):
            epoch(state, turn, strength * chance)
            loss = state.loss(aside, y[held])
            mine, idle = (loss, 0) if loss < mine - 1e-4 else (mine, idle + 1)
            if loss < least:
                best, least = state.copy(), loss
            if idle >= patience:
                break
        if least > before - 1e-3:
            break
    m = Model(terms, best.weights, best.factors, best.offset, 1.0, 0.0)
    m.scale, m.shift = _logistic(best.judged(aside), y[held])
    live = (m.weights != 0) | (m.factors != 0).any(1)
    return Model(terms[live], m.weights[live].astype("f4"), m.factors[live].astype("f4"), m.offset, m.scale, m.shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of sigmoid(scale * (x + shift)) with least loss, found on a grid that is made finer twice."""
    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - y * z).mean()) + 1e-4 * (np.log(a) ** 2 + (b / a) ** 2)

    best, shift, width = 1.0, 0.0, 1.0
    for _ in range(4):
        scales = best * np.exp(width * np.linspace(-1.5, 1.5, 13))
        shifts = shift + width * np.linspace(-4, 4, 17)
        _, best, shift = min((loss(a, a * b), a, b) for a in scales for b in shifts)
        width /= 4
    return float(best), float(best * shift)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 30_000) -> Model:
    """Train on rows of df with a label of 0 or 1, at most about `most` of them, chosen by a hash of the id.

    A repeated id in `labels` counts as toxic if one of its rows does. The chosen labels, at most about `most`
    pairs of id and bit, are broadcast to the texts; only hashed terms come to the driver.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) < int((1 << 20) * most / n))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.unique(np.fromiter(map(term_hash, words(t)), "i4")).astype("i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["terms", "label"])

    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id").select("_text", "_label").transform(in_batches, run, "terms binary, label int").toArrow()
    # sorted, so that the model doesn't depend on the order in which tasks end
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    rows, ys = [np.frombuffer(t, "i4") for t, _ in pairs], np.array([y for _, y in pairs], "i8")
    del got, pairs
    give_back(df.sparkSession)
    try:
        return fit(rows, ys)
    finally:  # the driver holds nothing of the training through what follows
        give_back()


class Scorer:
    """Scores whole texts; a table of word -> place in the model is kept up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        at = np.full(BUCKETS, -1, "i4")
        at[model.terms] = np.arange(len(model.terms))
        self.at = array("i", at.tobytes())  # place of each bucket in the model, or -1
        self.places = Bounded(self._place)

    def _place(self, word: str) -> int:
        return self.at[term_hash(word)]

    def __call__(self, text: str | None) -> float:
        at = {k for k in map(self.places.__getitem__, words(text)) if k >= 0}
        return probability(self.model, np.array(sorted(at), "i8"))


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), predicted (1 from the threshold on) of each row, from its whole text alone.

    A null text counts as an empty one, which gets the score of no term; repeated rows get the same score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS terms of 1 + FACTORS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(shared.value)
        for batch in batches:
            scores = np.array([judge(t) for t in batch.column(1).to_pylist()], "f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype("i4"))], names=[id_col, "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).transform(in_batches, run, f"`{id_col}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs scored under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([judge(t) < threshold for t in batch.column(batch.schema.names.index(text_col)).to_pylist()], pa.bool_()))

    return docs.transform(in_batches, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
