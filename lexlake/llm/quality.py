"""Quality classifier by compression with dictionaries.

Two zstandard dictionaries are trained, on good and on bad labelled text. Each text is cut into windows over its whole
length; every window is compressed with either dictionary and with none. The evidence is the normalised difference of the sizes
under the two dictionaries (over the whole text, and its least and greatest over windows), with the same difference between either's
and the plain size, and between the plain size and the text's own, and the length. A logistic calibration, fitted on labelled rows that the dictionaries have
not seen, makes it the probability of label 1 at the share that label 1 has among the labels. Evidence beyond what the calibration saw
counts as its end, and a text of few bytes is drawn to that share (half way at ``SHORT`` bytes).

Labels are learnt from at most ``per_class`` rows of each label (those with the smallest hash of the id), one row for an id. Of those
for the dictionaries at most ``dict_chars`` characters each go to the driver; the others are measured whole, in tasks, and six
numbers each go to the driver. Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are never learnt from. Texts alone are
scored.

A null text is the empty text. An empty text has the share of label 1 as its score. Labels other than 0 and 1, or
null, are left out; a doc_id with both labels counts as bad. With no labels of one kind every score is 0.5 or more if
only good ones are known, below if only bad ones. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

WINDOW = 2_048
LEVEL = 3
#: Bytes at which a text's own evidence and the share of label 1 weigh the same.
SHORT = 32
FEATURES = 6


class Model:
    """Dictionaries and calibration; ``weights`` are for the columns of ``features``."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None, ends: np.ndarray | None = None, prior: float = 0.0):
        self.good, self.bad, self.weights, self.ends, self.prior = good, bad, weights, ends, prior  # prior: log odds of label 1

    @functools.cached_property
    def packers(self) -> list:
        made = []
        for raw in (self.good, self.bad, b""):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        if not raw:
            return [0.0] * FEATURES
        apart = lambda x, y: (x - y) / (x + y)
        good = bad = plain = 0
        low, high = 1.0, -1.0
        for k in range(0, len(raw), WINDOW):
            part = raw[k : k + WINDOW]
            g, b, p = (len(x.compress(part)) for x in self.packers)
            good, bad, plain = good + g, bad + b, plain + p
            if len(part) >= WINDOW // 2 or k == 0:
                low, high = min(low, apart(b, g)), max(high, apart(b, g))
        return [apart(bad, good), low, high, apart(plain, good), apart(len(raw), plain), float(np.log(len(raw)))]

    def expand(self, rows: np.ndarray) -> np.ndarray:
        low, high, mean, scale = self.ends
        z = (np.clip(rows, low, high) - mean) / scale
        k = z.shape[1]
        return np.hstack([np.ones((len(z), 1)), z] + [z[:, [i]] * z[:, [j]] for i in range(k) for j in range(i, k)])

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.asarray(rows, float).reshape(len(rows), FEATURES)
        size = np.where((x == 0).all(1), 0.0, np.exp(x[:, -1]))
        trust = size / (size + SHORT)
        own = self.expand(x) @ self.weights if self.weights is not None else np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(trust * own + (1 - trust) * self.prior, -30, 30)))

    def calibrate(self, rows: list[list[float]], labels: list[int], ridge: float = 1.0) -> Model:
        """Logistic regression by Newton steps, with a ridge; the sample's share of label 1 gives way to the prior."""
        x, y = np.asarray(rows, float), np.asarray(labels, float)
        self.ends = np.stack([x.min(0), x.max(0), x.mean(0), x.std(0) + 1e-9])
        x = self.expand(x)
        w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep + 1e-6), x.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        w[0] += self.prior - np.log(y.sum() / (len(y) - y.sum()))
        self.weights = w
        return self


def dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where zstandard finds too little to train on, the end of the texts themselves is one."""
    parts = [raw[k : k + WINDOW] for t in texts for raw in [t.encode("utf-8", "replace")] for k in range(0, len(raw), WINDOW) if raw[k : k + WINDOW]]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 4), parts, k=200, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-size:]


def fold(id_col: str = "doc_id", folds: int = 3):
    return F.crc32(F.col(id_col).cast("string")) % folds


def measured(texts: DataFrame, model: Model) -> DataFrame:
    """y and the features of each row (y, text)."""
    shipped = texts.sparkSession.sparkContext.broadcast((model.good, model.bad))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            rows = [own.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    return texts.select("y", "text").mapInArrow(run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, dict_chars: int = 4_096, dict_bytes: int = 112_640, folds: int = 3, held_fold: int = 1) -> Model:
    """A model from a bounded sample of labelled rows outside the held fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(folds=folds) != held_fold))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"))
    shares = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = own.where("y = 0").orderBy(*order).limit(per_class).unionByName(own.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # at most 2 x per_class ids are broadcast
    known = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    known = materialize(docs.sparkSession, known, "labelled-texts")
    first = F.pmod("h", F.lit(5)) < 3
    # of a longer text the window starts anywhere
    at = (F.pmod("h", F.greatest(F.length("text") - dict_chars, F.lit(1))) + 1).cast("int")
    parts = known.where(first).select("y", "doc_id", F.col("text").substr(at, F.lit(dict_chars)).alias("part")).orderBy("doc_id").collect()
    model = Model(*(dictionary([r.part for r in parts if r.y == k], dict_bytes) for k in (1, 0)))
    model.prior = float(np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5)))
    rows = measured(known.where(~first), model).collect()
    if len({r.y for r in rows}) == 2 and len({r.y for r in parts}) == 2:
        order = sorted(range(len(rows)), key=lambda k: rows[k].x)  # the same sums in any order of rows
        model.calibrate([rows[k].x for k in order], [rows[k].y for k in order])
    return model


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``docs`` with ``columns`` kept, and score and predicted added; every whole text is scored in one pass."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(pickle.dumps((model.good, model.bad, model.weights, model.ends, model.prior)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*pickle.loads(shipped.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            s = own.scores([own.features(t) for t in texts]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = docs.select(*columns, text_of(text).alias("text to score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}{', ' if schema else ''}score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject. Columns get plain names on the way, so that none clashes."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = score(docs.toDF(*names), model, tuple(names), names[docs.columns.index("text")])
    return scored.where("predicted = 1").select(*names).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, **options), ("doc_id",))
    return scored.select("doc_id", F.coalesce(fold(folds=options.get("folds", 3)) == options.get("held_fold", 1), F.lit(False)).alias("held_out"), "score", "predicted")
