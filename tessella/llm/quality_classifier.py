"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Every passage is encoded from
its measurements; a gated attention learns from document labels alone how much
each passage weighs, and the weighted passage representation gives the score.
The whole text is scored, whatever its length.

The model is fitted with numpy on a bounded sample of labelled documents, each
with all of its passages: at most ``sample`` documents by the smallest hashes of
their ids, of which those with over a tenth of ``most`` passages are passed over
and the rest is taken in that order while it has at most ``most`` passages in all.
It never sees labels, language, source or id as inputs.

Edge cases: a text without words is one passage of zeros; labels other than 0
and 1 and labels of absent documents are ignored; of documents that repeat a
labelled id one is used; with one class or no label at all every score is the
share of label 1 (1 without labels); repeated rows, null ids and other columns
are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessella.llm import arrays, quality_rules
from tessella.llm.shared import beside

PASSAGE = 48
SAMPLE = 2000
MOST = 200_000
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4
THRESHOLD = 0.3

# The classes of characters that are counted.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:?", "loud": b"!", "bar": b"|", "symbol": b"#*$%&<>@^~=+_\\/", "high": range(128, 256)}
FEATURES = ["full", "chars", *CLASSES, "marked", "short", "distinct", "same", "repeated", "break", "size"]


def passages(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage, and the bounds of each document's passages."""
    data, off = arrays.text_bytes(table["text"])
    n = len(off) - 1
    starts, ends, doc = arrays.words(data, off)
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    per = np.maximum(1, -(-count // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(per)])
    own = bounds[:-1][doc] + place // PASSAGE
    total = int(bounds[-1])
    add = lambda values: np.bincount(own, weights=values, minlength=total)
    words = np.maximum(add(np.ones(len(own))), 1)
    length = (ends - starts).astype(float)
    size = np.maximum(add(length), 1)
    code, _ = arrays.coded(arrays.cut(data, starts, ends))
    in_class, marked = {}, np.zeros(len(own), bool)
    for name, members in CLASSES.items():
        hit = np.zeros(256, bool)
        hit[list(members)] = True
        at = np.flatnonzero(hit[data])
        word = np.searchsorted(starts, at, side="right") - 1
        in_class[name] = np.bincount(own[word], minlength=total) / size if len(own) else np.zeros(total)
        if name in ("symbol", "bar", "loud"):
            marked[word] = True
    first = np.ones(len(own), bool)
    if len(own):
        pair, _ = arrays.renumber(own, code)
        first[:] = False
        first[np.unique(pair, return_index=True)[1]] = True
    same = np.zeros(len(own), bool)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    breaks = np.flatnonzero(data == 10)
    after = np.searchsorted(starts, breaks, side="right") - 1
    inside = after >= 0
    broken = np.bincount(own[after[inside]], minlength=total) if len(own) else np.zeros(total)
    columns = {
        "full": add(np.ones(len(own))) / PASSAGE, "chars": add(length) / words / 10, **in_class, "marked": add(marked) / words,
        "short": add(length <= 3) / words, "distinct": add(first) / words, "same": add(same) / words,
        "repeated": add(quality_rules.repeated(code, doc)) / words, "break": np.minimum(broken / words, 1), "size": np.log1p(np.repeat(count, per)) / 10,
    }
    return np.stack([columns[f] for f in FEATURES], 1), bounds


@dataclass(frozen=True)
class Model:
    """Weights of the encoder, the gated attention and the output; or a constant."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return _sigmoid(_forward(self.weights, x, bounds)[0])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> tuple:
    starts, sizes = bounds[:-1], np.diff(bounds)
    if not len(starts):
        return (np.zeros(0),)
    x = (x - w["mean"]) / w["scale"]
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["attend"]), _sigmoid(h @ w["gate"])
    e = (t * g) @ w["weigh"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return z @ w["out"] + w["out0"], x, h, t, g, a, z


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit the weights to document labels by full-batch Adam."""
    if not len(y) or y.min() == y.max():
        return Model({}, float(y[0]) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {"encode": draw(x.shape[1], HIDDEN), "encode0": np.zeros(HIDDEN), "attend": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE), "weigh": draw(GATE), "out": draw(HIDDEN), "out0": np.zeros(1)}
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    moment, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    sizes = np.diff(bounds)
    for step in range(1, STEPS + 1):
        out, xs, h, t, g, a, z = _forward(w | fixed, x, bounds)
        err = (_sigmoid(out) - y) / len(y)
        dz = np.repeat(err[:, None] * w["out"], sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
        dt, dg = de[:, None] * w["weigh"] * g * (1 - t * t), de[:, None] * w["weigh"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T) * (1 - h * h)
        grads = {"encode": xs.T @ dh, "encode0": dh.sum(0), "attend": h.T @ dt, "gate": h.T @ dg, "weigh": (t * g).T @ de, "out": z.T @ err, "out0": np.array([err.sum()])}
        for k, grad in grads.items():
            grad = grad + DECAY * w[k]
            moment[k] = 0.9 * moment[k] + 0.1 * grad
            square[k] = 0.999 * square[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w | fixed)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model:
    """Fit on at most ``sample`` of the labelled documents, with ``most`` passages in all.

    ``labels`` has ``doc_id`` and ``quality``.  What reaches the driver is at
    most ``most`` rows of features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            x, bounds = passages(table)
            fits = np.diff(bounds) <= most // 10
            kept = [x[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1][fits], bounds[1:][fits], strict=True)]
            table, n = table.filter(pa.array(fits)), np.diff(bounds)[fits]
            yield pa.RecordBatch.from_arrays([arrays.plain(table["doc_id"]), arrays.plain(table["quality"]), pa.array(n), pa.array(kept, pa.binary())], ["doc_id", "quality", "n", "x"])

    drawn = rows.mapInArrow(run, "doc_id bigint, quality int, n bigint, x binary").groupBy("doc_id", "quality").agg(F.min(F.struct("n", "x")).alias("m"))
    # The window is over at most ``sample`` rows.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0)
    found = drawn.select("doc_id", "quality", "m.x", F.sum("m.n").over(order).alias("so_far")).filter(F.col("so_far") <= most).collect()
    found.sort(key=lambda r: (r.doc_id, r.quality))
    bags = [np.frombuffer(bytes(r.x), "<f4").reshape(-1, len(FEATURES)).astype(float) for r in found]
    x = np.concatenate(bags) if bags else np.zeros((0, len(FEATURES)))
    return train(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(int), np.array([r.quality for r in found], float))


def scored(docs: DataFrame, model: Model, key: Column) -> DataFrame:
    """``key, n_passages, score`` per row of ``docs``."""
    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["key"], StructField("n_passages", LongType()), StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            x, bounds = passages(table)
            columns = [table["key"], pa.array(np.diff(bounds)), pa.array(model.scores(x, bounds))]
            yield from pa.Table.from_arrays(columns, ["key", "n_passages", "score"]).to_batches()

    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns."""
    rows, (score,) = beside(docs, lambda table: [pa.array(model.scores(*passages(table)))], [StructField("score", DoubleType())])
    return rows.filter(F.col(score) >= threshold).drop(score)


def held_out(parts: int) -> Column:
    """True for the rows that no fitting may read: one id in ``parts``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))
