"""Toxicity: a cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 to 3 of growing severity. The labels only tell toxic from clean, so the grade of a toxic training
text is 1 plus the third in which its share of marked words lies (the part of its words that are much more frequent in toxic
texts), whatever its length. P(grade > k) = sigmoid(w . x - c_k) with one weight vector w for all thresholds c_0 < c_1 < c_2. The features are words and
beginnings of words, of four and five bytes; each gives log2(1 + count) and its count per hundred words, as what is a
word by chance in a long text is a habit in a short one. The expected severity is the sum of the three probabilities; a text is
toxic from P(grade > 0) >= 0.5. Every feature counts that SUPPORT texts have and whose frequencies in toxic and clean texts differ
beyond chance, however many these are; texts are rows of a sparse matrix.

The model is fitted on the driver to a bounded sample of the labelled rows, the SAMPLE with the smallest hashes of their ids. From
these come the distinct features that SUPPORT texts of the sample have and their counts, not texts. Texts that share their least
feature hashes are copies and count once. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, tidy, trim
from .words import PLAIN, word_features

#: Labelled rows that the model is fitted to at most.
SAMPLE = 6000
#: Texts that must have a feature, and the least likelihood ratio between a feature and the label (chance: 1 in a million).
SUPPORT, GAIN = 5, 25.0
GRADES = 4
#: Bytes at the beginning of a word that are a feature of their own.
BEGINNINGS = (4, 5)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights (of the logarithms, then of the shares), and the thresholds."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, texts: Iterator[np.ndarray] | list[np.ndarray]) -> np.ndarray:
        """w . x of each text, given by its features with repetitions (kind, word)."""
        out = []
        for words in texts:
            flat = words.ravel()
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            which, counts = counted(flat[self.words[at] == flat] if len(self.words) else flat[:0])
            x = rows_of(self.words, which, counts, words.shape[-1])
            out.append(float(x[1] @ self.weights[x[0]]))
        return np.array(out)

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by w . x."""
        return _sigmoid(z[..., None] - self.cuts)


def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text, ascending, and how often each occurs; 0 is none."""
    which, counts = np.unique(words, return_counts=True)
    start = int(len(which) > 0 and which[0] == 0)
    return which[start:], counts[start:]


def rows_of(known: np.ndarray, which: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text's row: log2(1 + count) of each known feature, then its count per hundred words, 5 at most."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(known, which), len(known) - 1)
    hit = known[at] == which
    at, n = at[hit], counts[hit]
    return np.concatenate([at, at + len(known)]), np.concatenate([np.log2(1 + n), np.minimum(100 * n / max(20, length), 5)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Sparse:
    """Rows of columns and values, for products with a vector from either side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = np.array([len(c) for c, _ in rows], np.int64)
        self.shape = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.column = np.concatenate([np.zeros(0, np.int64), *[c for c, _ in rows]])
        self.value = np.concatenate([np.zeros(0), *[v for _, v in rows]])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * z[self.row], self.shape[1])


def dense_rows(x: np.ndarray) -> Sparse:
    return Sparse([(np.arange(x.shape[1]), np.asarray(r, float)) for r in x], x.shape[1])


def likelihood(x: Sparse, y: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of grades y without the penalty on w, and its gradient by w, the first threshold and the log gaps."""
    n = x.shape[0]
    cuts = np.cumsum(np.concatenate([first, np.exp(gaps)]))
    above = np.concatenate([np.ones((n, 1)), _sigmoid(x.times(w)[:, None] - cuts), np.zeros((n, 1))], axis=1)
    p = np.maximum(np.take_along_axis(above, y[:, None], 1) - np.take_along_axis(above, y[:, None] + 1, 1), 1e-9)
    slope = above * (1 - above)
    lower, upper = np.take_along_axis(slope, y[:, None], 1) / p, np.take_along_axis(slope, y[:, None] + 1, 1) / p
    dz = (lower - upper)[:, 0]  # of the log-likelihood by w . x
    dcut = np.array([np.where(y == k + 1, -lower[:, 0], np.where(y == k, upper[:, 0], 0)).sum() for k in range(GRADES - 1)])
    later = np.cumsum(dcut[::-1])[::-1]
    return float(np.log(p).mean() - penalty / 2 * (w @ w)), np.concatenate([x.back(dz) / n - penalty * w, [later[0] / n], later[1:] * np.exp(gaps) / n])


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, steps: int = 400, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of grades y (0 to GRADES - 1), by Adam on all rows.

    The first threshold is free and the others are it plus positive gaps, so they stay in order.
    """
    x = x if isinstance(x, Sparse) else dense_rows(x)
    d = x.shape[1]
    w, first, gaps = np.zeros(d), np.array([1.0]), np.zeros(GRADES - 2)
    m = [np.zeros(d + GRADES - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        _, grad = likelihood(x, y, w, first, gaps, penalty)
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        move = 0.1 * (1 - step / (steps + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-10)
        w, first, gaps = w + move[:d], first + move[d : d + 1], gaps + move[d + 1 :]
    return w, np.cumsum(np.concatenate([first, np.exp(gaps)]))


#: A text: the features that are common enough, how often each occurs, its number of words, its label, its least features of all.
Text = tuple[np.ndarray, np.ndarray, int, int, bytes]


def _distinct(texts: list[Text]) -> list[Text]:
    """One text of each set that shares its eight least feature hashes and its label."""
    return list({(t[4], t[3]): t for t in texts}.values())


def fit(texts: list[Text]) -> Model:
    """The model of labelled texts (0 clean, 1 toxic). Without toxic rows nothing is toxic, without clean ones all is."""
    texts = _distinct(texts)
    y = np.array([t[3] for t in texts], np.int64)
    toxic = int(y.sum())
    if not toxic or toxic == len(texts):
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.array([40.0, 41, 42]) if not toxic else np.array([-40.0, 40, 41]))
    totals = np.array([len(texts) - toxic, toxic], float)
    seen = [np.unique(np.concatenate([t[0] for t in texts if t[3] == label]), return_counts=True) for label in (0, 1)]
    names = np.union1d(seen[0][0], seen[1][0])
    counts = np.zeros((len(names), 2))
    for label, (found, n) in enumerate(seen):
        counts[np.searchsorted(names, found), label] = n
    often = counts.sum(axis=1) >= SUPPORT
    names, counts = names[often], counts[often]
    total = counts.sum(axis=1, keepdims=True)
    expected = total * totals / totals.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(a > 0, a * np.log(a / b), 0)
        gain = 2 * (part(counts, expected) + part(totals - counts, totals - expected)).sum(axis=1)  # likelihood ratio of each word
    good = gain > GAIN
    words, counts = names[good], counts[good]
    marked = words[counts[:, 1] / totals[1] > 3 * counts[:, 0] / totals[0]]
    share = np.array([t[1][np.isin(t[0], marked)].sum() / max(20, t[2]) for t in texts])
    thirds = np.quantile(share[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (share > thirds[0]).astype(int) + (share > thirds[1]), 0)
    w, cuts = fit_ordinal(Sparse([rows_of(words, *t[:3]) for t in texts], 2 * len(words)), grade)
    return Model(words, w, cuts)


def _features(text: pa.Array) -> Iterator[np.ndarray]:
    """(kind, word) of each text, 32 bits of each hash; 0 where a word has no such feature."""
    for found in word_features(text, PLAIN, BEGINNINGS):
        yield (found >> np.uint64(32)).astype(np.uint32)


_FIELDS = ["which", "counts", "length", "toxic", "least"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(*counted(w), w.shape[1]) for w in _features(batch.column("text"))]
        columns = [pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.uint32).tobytes() for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())]
        yield pa.record_batch([*columns, batch.column("toxic"), pa.array([x[0][:8].tobytes() for x in found], pa.binary())], _FIELDS)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which = np.frombuffer(b"".join(batch.column("which").to_pylist()), np.uint32)
        yield pa.record_batch([pa.array(which.astype(np.int64))], ["feature"])


def _narrowed(known: np.ndarray):
    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, counts = [], []
            for w, n in zip(batch.column("which").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                w, n = np.frombuffer(w, np.uint32), np.frombuffer(n, np.uint32)
                keep = np.isin(w, known, assume_unique=True)
                which.append(w[keep].tobytes())
                counts.append(n[keep].tobytes())
            yield pa.record_batch([pa.array(which, pa.binary()), pa.array(counts, pa.binary()), *(batch.column(c) for c in _FIELDS[2:])], _FIELDS)

    return narrowed


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits to the texts of at most SAMPLE rows of `labels` (id_col, label_col 0 or 1; rows with a null are left out).

    An id labelled both ways counts as toxic. Rows of `docs` that share a labelled id all count, 2 * SAMPLE texts at most, those with the
    smallest hashes. The driver gets the features that SUPPORT of these texts have, and each text's counts of them.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    picked = picked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "id").select("text", "toxic")
    schema = "which binary, counts binary, length long, toxic int, least binary"
    hashed = stored(texts.mapInArrow(tidy(_hashed), schema))
    if hashed.count() > 2 * SAMPLE:
        hashed = stored(hashed.orderBy(F.xxhash64("which", "counts"), "toxic").limit(2 * SAMPLE))
    often = hashed.select("which").mapInArrow(tidy(_each), "feature long").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("feature").toArrow()
    known = np.sort(often.column("feature").to_numpy().astype(np.uint32))
    rows = hashed.mapInArrow(tidy(_narrowed(known)), schema).toArrow()
    texts = sorted(zip(*(rows.column(c).to_pylist() for c in _FIELDS), strict=True))  # alike however rows were dealt
    model = fit([(np.frombuffer(which, np.uint32), np.frombuffer(counts, np.uint32), *rest) for which, counts, *rest in texts])
    del rows, texts, often, known
    trim()
    return model


def _scores(model: Model):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(model.score(_features(batch.column("text"))))
            n = batch.num_rows
            share = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1))
            yield pa.record_batch([*batch.columns, pa.array(above.sum(axis=1).round(6)), pa.array(share.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)], [*batch.schema.names, "severity", "grade", "toxic"])

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, severity (expected grade, 0 to 3), grade (the likeliest), toxic (rejected).

    Null text counts as empty. Repeated rows are scored alike and null ids are kept; other columns are ignored; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [*source.schema, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return source.mapInArrow(tidy(_without_text(_scores(model))), T.StructType([f for f in fields if f.name != "text"])).withColumnRenamed("id", id_col)


def _without_text(step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step(batches):
            yield out.drop_columns(["text"])

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """`docs`, all its columns, without the rows whose `text` is rejected; null text stays."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(model.score(_features(batch.column("text"))))
            yield batch.filter(pa.array(above[:, 0] < 0.5))

    return docs.mapInArrow(tidy(keep), docs.schema)
