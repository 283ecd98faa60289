"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector for all grades, thresholds in order (kept so by
storing their gaps as logarithms). Selection uses the tail P(grade >= g) or the expected grade.

Features of a text, hashed: its lower-case words without outer ASCII signs (1 + log of the count), runs of 4 and 5 bytes of them, and the shapes of its words (runs of
capitals, small letters, digits, and signs as they are; share of all words). Features of fewer than ``MIN_DOCS`` sampled documents,
or that do not depend on the grade (chi-square), get no weight.

The model is fitted in one task on a bounded sample: at most ``SAMPLE`` rated documents, the same number of each grade at most,
in hash order of id, of which near copies (a common smallest shingle hash under one of four orders) leave. The model (two megabytes) is sent to all tasks; scoring covers every row.

Defined results: null and empty texts have no features and score as the thresholds say; unrated, null or foreign grades are not
sampled; without any rated row every document has null scores and is kept; repeated rows are scored each; very long texts are scored whole; a tail equal to the
threshold is kept; an empty table gives an empty table; further columns are kept, whatever their names (an input column named like the output, in any case of letters, is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_chunks, but, by_place, lower_ascii, mix64, shingle_sets, span_hashes, with_field, word_spans, words_per_text

#: Hash spaces of words, of pieces of words, and of shapes, one after the other.
WORD_BITS, GRAM_BITS, SHAPE_BITS = 18, 18, 12
SHAPES_AT = (1 << WORD_BITS) + (1 << GRAM_BITS)
DIM = SHAPES_AT + (1 << SHAPE_BITS)
GRAMS = (4, 5)
#: Rated documents that a model is fitted on, at most.
SAMPLE = 9_000
MIN_DOCS = 4
#: Bytes of text whose features are made at once: a byte takes some hundred bytes of arrays.
CHUNK = 1 << 19
#: Least chi-square of a feature's presence against the grades: a constant, and a part of the sample's size.
MIN_CHI2, CHI2_PART = 15.0, 0.01
EPOCHS = 150
SHAPE_SCALE = 6.0

#: Multipliers that order shingle hashes in four ways.
_ORDERS = mix64(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_INNER = (_CLASS >= 1) & (_CLASS <= 3)


def _trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without outer signs; a word of signs alone becomes empty."""
    inner = np.concatenate([[0], np.cumsum(_INNER[data])])
    places = np.flatnonzero(_INNER[data])
    first = inner[starts]
    last = inner[ends]
    some = last > first
    a, b = starts.copy(), starts.copy()
    a[some] = places[first[some]]
    b[some] = places[last[some] - 1] + 1
    return a, b


def features(column: pa.Array, useful: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of every text; useful: mask of the features that are wanted."""
    for _, _, data, offsets in as_chunks(column, CHUNK):
        n = len(offsets) - 1
        starts, ends = word_spans(data, offsets)
        borders = words_per_text(offsets, starts)
        doc = np.repeat(np.arange(n), borders[1:] - borders[:-1])
        a, b = _trim(data, starts, ends)
        full = b > a
        small = lower_ascii(data)
        found = [(doc[full], (span_hashes(small, a[full], b[full]) >> np.uint64(64 - WORD_BITS)).astype(np.int64))]
        # pieces of words: runs of GRAMS bytes
        wide = small.astype(np.uint64) + np.uint64(1)
        for grams in GRAMS:
            if len(data) < grams:
                continue
            inside = np.zeros(len(data) + 1, np.int32)
            enough = full & (b - a >= grams)
            np.add.at(inside, a[enough], 1)
            np.add.at(inside, b[enough] - grams + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[: len(data) - grams + 1]) > 0)
            total = np.zeros(len(data) - grams + 1, np.uint64)
            for k in range(grams):
                total = total * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + len(total)]
            index = ((total[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)
            if useful is not None:
                keep = useful[index]
                at, index = at[keep], index[keep]
            found.append((np.searchsorted(offsets, at, "right") - 1, index))
        # shapes: the first byte of every run of one class
        kind = _CLASS[data]
        new = np.ones(len(data) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[starts] = True
        upto = np.concatenate([[0], np.cumsum(new[:-1])])
        shapes = (span_hashes(kind[new[:-1]], upto[starts], upto[ends]) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + SHAPES_AT
        found.append((doc, shapes))
        # words that equal one of the two before them
        hashes = span_hashes(data, starts, ends)
        for back in (1, 2):
            same = np.flatnonzero((hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])) + back
            found.append((doc[same], np.full(len(same), DIM - back, np.int64)))
        docs, index = (np.concatenate(x) for x in zip(*found))
        if useful is not None:
            keep = useful[index]
            docs, index = docs[keep], index[keep]
        keys, counts = np.unique(docs * (1 << 21) + index, return_counts=True)
        docs, index = keys >> 21, keys & ((1 << 21) - 1)
        words = np.maximum(1, borders[1:] - borders[:-1])
        values = np.where(index >= SHAPES_AT, SHAPE_SCALE * counts / words[docs], 1.0 + np.log(counts))
        cut = np.searchsorted(docs, np.arange(n + 1))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield index[x:y], values[x:y]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, column: pa.Array) -> np.ndarray:
        useful = self.weights != 0
        return np.array([float(self.weights[i] @ v) for i, v in features(column, useful)], np.float64)


def informative(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> np.ndarray:
    """Features whose presence depends on the grade."""
    total = np.bincount(grades, minlength=levels).astype(np.float64)
    seen = np.zeros((levels, DIM))
    for g in range(levels):
        own = [rows[k][0] for k in np.flatnonzero(grades == g)]
        if own:
            seen[g] = np.bincount(np.concatenate(own), minlength=DIM)
    every = seen.sum(axis=0)
    share = every / max(1.0, total.sum())
    expected = total[:, None] * share[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where(expected > 0, (seen - expected) ** 2 / (expected * np.maximum(1.0 - share, 1e-12)), 0.0).sum(axis=0)
    return (every >= MIN_DOCS) & (chi2 >= MIN_CHI2 + CHI2_PART * total.sum())


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, *, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> OrdinalModel:
    """Adam on minibatches of the negative log-likelihood."""
    common = informative(rows, grades, levels)
    chosen = np.flatnonzero(common)
    dense = np.cumsum(common) - 1  # a chosen feature's place among the chosen
    kept = [(dense[i[common[i]]], v[common[i]]) for i, v in rows]
    index = np.concatenate([i for i, _ in kept]).astype(np.int64)
    value = np.concatenate([v for _, v in kept]).astype(np.float64)
    border = np.concatenate([[0], np.cumsum([len(i) for i, _ in kept])]).astype(np.int64)
    size = len(chosen)
    gaps = levels - 1
    parameters = np.zeros(size + gaps)
    parameters[size] = -1.0
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    order = np.random.default_rng(seed)
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
            at = np.concatenate([np.arange(border[r], border[r + 1]) for r in part])
            row = np.repeat(np.arange(len(part)), border[part + 1] - border[part])
            i, v, y = index[at], value[at], grades[part]
            s = np.bincount(row, weights=parameters[i] * v, minlength=len(part))
            theta = np.concatenate([[parameters[size]], parameters[size] + np.cumsum(np.exp(parameters[size + 1 :]))])
            # upper and lower border of each grade's interval
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                up, low = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            gradient = np.zeros_like(parameters)
            gradient[:size] = np.bincount(i, weights=v * ((d_up - d_low)[row]), minlength=size) / len(part)
            d_theta = np.zeros(gaps)
            for j in range(gaps):
                d_theta[j] = (-(d_up[y == j]).sum() + (d_low[y == j + 1]).sum()) / len(part)
            gradient[size] = d_theta.sum()
            for j in range(1, gaps):
                gradient[size + j] = d_theta[j:].sum() * np.exp(parameters[size + j])
            gradient[:size] += decay * parameters[:size]
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient * gradient
            pace = rate * (1 - epoch / epochs)
            parameters -= pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[parameters[size]], parameters[size] + np.cumsum(np.exp(parameters[size + 1 :]))])
    weights = np.zeros(DIM, np.float32)
    weights[chosen] = parameters[:size]
    return OrdinalModel(weights, theta)


def sample_rated(docs: DataFrame, ratings: DataFrame, *, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> DataFrame:
    """(text, grade) of at most ``sample`` rated documents, at most sample / levels of each grade."""
    rated = ratings.select(F.col(id_col).alias("r_id"), F.col(grade_col).cast("int").alias("grade")).filter(F.col("grade").between(0, levels - 1) & F.col("r_id").isNotNull())
    # ratings of documents that are not there take no place in the sample
    there = docs.select(F.col(id_col).alias("r_id")).distinct()
    rated = rated.join(there.hint("merge"), "r_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("grade").orderBy(F.xxhash64("r_id"), "r_id"))
    few = rated.withColumn("rank", rank).filter(F.col("rank") <= sample // levels).drop("rank")
    # bounded by sample; a rating counts once, with the smallest of its id's texts, however many rows have that id
    met = docs.select(F.col(id_col).alias("r_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "r_id")
    return met.groupBy("r_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")


def train(sampled: DataFrame, levels: int) -> OrdinalModel | None:
    """Fit in one task; only the model comes back."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(features(b.column(0)))
            data = [[i.astype(np.int32).tobytes() for i, _ in found], [v.astype(np.float32).tobytes() for _, v in found]]
            marks = [[int((s * k).min().astype(np.int64)) if len(s) else 0 for k in _ORDERS] for s in shingle_sets(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary()), b.column(1), pa.array(marks, pa.list_(pa.int64()))], names=["i", "v", "grade", "marks"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades, marks = [], [], []
        for b in batches:
            for i, v, g, m in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)))
                grades.append(g)
                marks.append(list(enumerate(m)))
        if rows:
            # the order of rows must not depend on how they arrived
            order, seen = [], set()
            for k in sorted(range(len(rows)), key=lambda k: (marks[k], grades[k], rows[k][0].tobytes())):
                if not seen.intersection(marks[k]):
                    order.append(k)
                seen.update(marks[k])
            model = fit_ordinal([rows[k] for k in order], np.array([grades[k] for k in order]), levels)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tobytes()], pa.binary())], names=["w", "t"])

    got = sampled.mapInArrow(extract, "i binary, v binary, grade int, marks array<long>").repartition(1).mapInArrow(fit, "w binary, t binary").collect()
    if not got:
        return None
    return OrdinalModel(np.frombuffer(bytes(got[0]["w"]), np.float32), np.frombuffer(bytes(got[0]["t"]), np.float64))


def score(docs: DataFrame, model: OrdinalModel | None, *, text_col: str = "text", keep_grade: int = 2, keep_at: float = 0.5, into: str = "quality") -> DataFrame:
    """docs with a struct column: expected grade, tail = P(grade >= keep_grade), keep = tail >= keep_at."""
    kept = but(docs, into)
    where = {c: i for i, c in enumerate(docs.columns)}
    schema = with_field(docs, into, "struct<expected:double,tail:double,keep:boolean>")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            n = b.num_rows
            if own is None:
                expected = tail = pa.nulls(n, pa.float64())
                keep = np.ones(n, bool)
            else:
                tails = own.tails(own.score(b.column(where[text_col]))) if n else np.zeros((0, len(own.thresholds)))
                expected, tail = pa.array(tails.sum(axis=1)), pa.array(tails[:, keep_grade - 1])
                keep = tails[:, keep_grade - 1] >= keep_at
            struct = pa.StructArray.from_arrays([expected, tail, pa.array(keep)], names=["expected", "tail", "keep"])
            yield pa.RecordBatch.from_arrays([*[b.column(where[c]) for c in kept], struct], names=[*kept, into])

    return by_place(docs).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from two binary labels: one point for quality, one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, *, levels: int = 3, keep_at: float = 0.5, into: str = "quality") -> DataFrame:
    """docs scored by a model fitted on the rated ones among them. labels: doc_id, grade."""
    return score(docs, train(sample_rated(docs, labels, levels=levels), levels), keep_grade=levels - 1, keep_at=keep_at, into=into)
