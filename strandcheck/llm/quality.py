"""Quality scores: document statistics, random Fourier features, ridge regression from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import by_ids, combined, given_back, held_out, in_small_parts, text_bytes, text_chunks, white_space_words

FEATURES = 128
#: Width of the Gaussian kernel on standardised statistics.
WIDTH = 4.0
PENALTY = 1e-3
#: Levels of ridge scores that the calibration tells apart, over [-0.5, 1.5].
LEVELS = 1000
THRESHOLD = 0.3

# Byte classes whose shares are statistics.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#$%&*@^~+=<>{}[]\\_", b"\"'()-/:;", b"\n", bytes(range(128, 256)),
)
STATISTICS = len(CLASSES) + 9


def _table_of_classes() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        out[list(members)] = k
    return out


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values over all values of each text."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
    return np.bincount(o[first], minlength=n) / np.maximum(np.bincount(o, minlength=n), 1)


def statistics(texts: list[bytes], words=None) -> np.ndarray:
    """A row of numbers for each whole text; all 0 shares for an empty one."""
    words, n = words or white_space_words(), len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner_of_byte = np.repeat(np.arange(n), sizes)
    kinds = _table_of_classes()[np.frombuffer(b"".join(texts), np.uint8)]
    counts = np.bincount(owner_of_byte * (len(CLASSES) + 1) + kinds, minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, : len(CLASSES)]
    hashes, owner = words(texts)
    n_words = np.bincount(owner, minlength=n)
    twin = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) if len(hashes) else np.zeros(0, bool)
    pairs, triples = combined(hashes, 2), combined(hashes, 5)
    in_one = [owner[: len(g)] == owner[len(owner) - len(g) :] for g in (pairs, triples)]
    lines = [t.split(b"\n") for t in texts]
    some = np.maximum(n_words, 1)
    return np.column_stack([
        np.sqrt(counts / np.maximum(sizes, 1)[:, None]),
        np.log1p(sizes), np.log1p(n_words), sizes / some / 10,
        _distinct_share(hashes, owner, n),
        _distinct_share(pairs[in_one[0]], owner[: len(pairs)][in_one[0]], n),
        _distinct_share(triples[in_one[1]], owner[: len(triples)][in_one[1]], n),
        np.sqrt(np.bincount(owner[1:][twin], minlength=n) / some) if len(hashes) else np.zeros(n),
        np.array([len(set(x)) / len(x) for x in lines]),
        np.log1p([len(x) for x in lines]),
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of each row's whole text; null counts as empty."""
    ship_package(docs.sparkSession)
    in_small_parts(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = white_space_words()
        for batch in batches:
            for part in text_chunks(batch):
                x = statistics(text_bytes(part.column("text")), words)
                offsets = pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda batches: given_back(measure(batches)), "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class Model:
    """Everything that a score needs; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a 1; the inner products of two rows approximate a Gaussian kernel."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.column_stack([np.cos(z) * np.sqrt(2 / self.directions.shape[1]), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 in [0, 1]; one half if there was nothing to learn from."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return self.levels[_level(self.raw(x))]


def _level(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * LEVELS).astype(np.int64), 0, LEVELS - 1)


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of ``ones / rows`` weighted by ``rows``; levels without rows lie between their neighbours."""
    blocks: list[list[float]] = []  # ones, rows, levels covered
    filled = np.flatnonzero(rows)
    for k in filled:
        blocks.append([float(ones[k]), float(rows[k]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    fitted = np.repeat([o / r for o, r, _ in blocks], [int(c) for _, _, c in blocks])
    return np.interp(np.arange(len(rows)), filled, fitted)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, seed: int = 5) -> Model:
    """Learns from the labelled rows of ``stats`` that :func:`held_out` leaves, all of them.

    Each task sums the normal equations of its rows; Spark adds the sums up. Every fifth of the remaining rows calibrates. Only
    sums come to the driver, in sizes that do not depend on the input. Null labels are ignored, repeated rows count repeatedly.
    """
    sums = stats.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    random = np.random.default_rng(seed)
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for row in sums:
        mean[row["k"]], scale[row["k"]] = row["m"], max(row["s"], 1e-6)
    model = Model(mean, scale, random.normal(0, 1 / WIDTH, (STATISTICS, features)), random.uniform(0, 2 * np.pi, features))
    known = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("bigint"), F.col(label).cast("double").alias("y"))
    calibrates = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string"))) % 5 == 0
    rows = materialize(stats.filter(~held_out()).join(known, "doc_id").select("x", "y", calibrates.alias("calibrates")), "labelled")
    size = features + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target, seen = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("x")))
                total += z.T @ z
                target += z.T @ batch.column("y").to_numpy()
                seen += len(z)
        if seen:
            values = np.concatenate([total[upper], target])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["k", "v"])

    summed = rows.filter(~F.col("calibrates")).select("x", "y").mapInArrow(equations, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    if not summed.num_rows:
        return model
    values = np.zeros(summed.num_rows)
    values[summed.column("k").to_numpy()] = summed.column("v").to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = values[:-size]
    gram = gram + gram.T - np.diag(np.diag(gram))
    model.weights = np.linalg.solve(gram + PENALTY * max(gram[-1, -1], 1) * np.eye(size) / size, values[-size:])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_level(model.raw(_matrix(batch.column("x"))))), batch.column("y")], names=["k", "y"])

    held = rows.filter("calibrates").select("x", "y").mapInArrow(levels, "k bigint, y double").groupBy("k").agg(F.sum("y").alias("ones"), F.count("y").alias("n")).toArrow()
    at, ones, counts = held.column("k").to_numpy(), np.zeros(LEVELS), np.zeros(LEVELS)
    ones[at], counts[at] = held.column("ones").to_numpy(), held.column("n").to_numpy()
    model.levels = isotonic(ones, counts) if len(at) else np.clip(np.linspace(-0.5, 1.5, LEVELS), 0, 1)
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs`` (``doc_id, text``), by a model learnt from ``labels`` (``doc_id`` and ``label``).

    Scores are calibrated shares of label 1; ``predicted`` is 1 from ``threshold`` on. Empty and null texts are scored
    like any other text; without labels all scores are 0.5; an empty table gives no rows; other columns are ignored.
    """
    stats = materialize(document_statistics(docs), "statistics")
    model = fit(stats, labels, label)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    out = stats.mapInArrow(apply, "doc_id bigint, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns. Rows with the same id are kept if one of them is; rows without an id too."""
    scores = materialize(scored(docs, labels, threshold=threshold), "scores")
    rejected = scores.filter("doc_id is not null").groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0")
    return by_ids(docs, rejected.select("doc_id"), "left_anti")
