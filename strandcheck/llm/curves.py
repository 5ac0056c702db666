"""Approximate nearest neighbours along shifted Hilbert curves of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package

NEIGHBOURS = 20
CURVES = 8
DIMENSIONS = 4
BITS = 8
#: Queries whose true neighbours are computed to choose how far to look along the curves, and the recall aimed at on them.
PROBES = 100
TARGET = 0.95
#: Rows of a curve that stay together; the least and the most.
LEAST_BLOCK, MOST_BLOCK = 512, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates in ``[0, 2**bits)``; at most 63 bits in all.

    Works on all points at once: from the coarsest bit down, the coordinates are reflected and exchanged with the first one so
    that each cell is entered where the one before is left, then the bits are interleaved as a Gray code.
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for k in range(n):
            set_ = (x[k] & q) != 0
            change = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ change)
            x[k] = np.where(set_, x[k], x[k] ^ change) if k else x[0]
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << bit)) != 0, turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((x[k] ^ turn) >> bit) & 1)
    return key


class Curves:
    """Random projections of vectors, each with a random shift of its grid, and the keys of vectors along each curve."""

    def __init__(self, centre: np.ndarray, spread: float, curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS, seed: int = 10):
        random = np.random.default_rng(seed)
        self.centre, self.bits, self.curves = centre, bits, curves
        size, dims = len(centre), min(dims, len(centre))
        turned = [np.linalg.qr(random.normal(size=(size, size)))[0] for _ in range(-(-curves * dims // size))]
        self.axes = np.concatenate(turned, axis=1)[:, : curves * dims].reshape(size, curves, dims)
        self.shifts = random.uniform(0, 1, (curves, dims))
        self.unit = max(spread, 1e-12) * 6 / (1 << (bits - 1))  # six deviations take half the grid, the shift the rest

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for c in range(self.curves):
            at = (vectors - self.centre) @ self.axes[:, c] / self.unit + (0.25 + 0.5 * self.shifts[c]) * (1 << self.bits)
            out.append(hilbert_keys(np.clip(at, 0, (1 << self.bits) - 1).astype(np.int64), self.bits))
        return out


def usable_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) of rows whose vector is not null, not zero, free of nulls and finite, in the most common length."""
    vector = F.col(column).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = rows.select(F.col("vec_id").cast("bigint"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & fine)
    length = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.filter(F.size("vector") == (length["size"] if length else 0))


def distinct_vectors(vectors: DataFrame, neighbours: int, every: int) -> DataFrame:
    """One row per different vector: ``node`` (its smallest id), ``vector``, the ``neighbours + 1`` smallest ids, and whether a query has it.

    Copies share one place on the curves; more of them than could be reported cannot change a result.
    """
    key = [F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")]
    marked = vectors.select("vec_id", "vector", key[0].alias("h1"), key[1].alias("h2"))
    asked = marked.groupBy("h1", "h2").agg(F.max(F.col("vec_id") % every == 0).alias("asked"))
    first = marked.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("r") <= neighbours + 1)
    grouped = first.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.min_by("vector", "vec_id").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return grouped.join(asked, ["h1", "h2"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _placed(nodes: DataFrame, curves: Curves, longest: float) -> DataFrame:
    """``curve, key, asks, node`` of each vector on each curve, and again as a query where it is one.

    The largest inner product is the nearest point once every vector has one more coordinate that
    brings it to the same length, and a query has 0 there.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, node, asked = _matrix(batch.column("vector")), batch.column("node").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            more = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
            for asks, rows, last in ((0, np.ones(len(x), bool), more), (1, asked, more * 0)):
                for c, key in enumerate(curves.keys(np.column_stack([x, last])[rows]) if rows.any() else []):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), c, np.int32)), pa.array(key), pa.array(np.full(len(key), asks, np.int32)), pa.array(node[rows])],
                        names=["curve", "key", "asks", "node"],
                    )

    return nodes.select("node", "vector", "asked").mapInArrow(place, "curve int, key bigint, asks int, node bigint")


def _positions(placed: DataFrame) -> DataFrame:
    """Adds ``pos``: how many vectors stand before a row on its curve. Ranges of keys are sorted and counted apart, then put in a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, vector = batch.column("curve").to_numpy(), 1 - batch.column("asks").to_numpy()
            local = np.zeros(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                own = curve == c
                local[own] = seen.get(c, 0) + np.cumsum(vector[own]) - vector[own]
                seen[c] = seen.get(c, 0) + int(vector[own].sum())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("curve", "asks", "node")), pa.array(np.full(len(curve), part, np.int32)), pa.array(local)],
                names=["curve", "asks", "node", "part", "local"],
            )

    order = ["curve", "key", "node", "asks"]
    schema = "curve int, asks int, node bigint, part int, local bigint"
    ranged = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), "ranged")
    sizes = ranged.groupBy("curve", "part").agg(F.sum(1 - F.col("asks")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("curve", "part", before.alias("before"))
    return ranged.join(offsets, ["curve", "part"]).select("curve", "asks", "node", (F.col("before") + F.col("local")).alias("pos"))


def _true_neighbours(nodes: DataFrame, probes: np.ndarray, ids: np.ndarray, neighbours: int) -> DataFrame:
    """``probe, node`` of the largest inner products with a few query vectors, over all vectors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, node = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                mine = batch.column("node").to_numpy()
                s = probes @ _matrix(batch.column("vector")).T
                s[ids[:, None] == mine] = -np.inf
                score, node = np.concatenate([score, s], axis=1), np.concatenate([node, np.broadcast_to(mine, s.shape)], axis=1)
                top = np.argsort(-score, axis=1)[:, :neighbours]
                score, node = np.take_along_axis(score, top, 1), np.take_along_axis(node, top, 1)
        n = node.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(node.ravel()), pa.array(score.ravel())], names=["probe", "node", "score"])

    found = nodes.select("node", "vector").mapInArrow(best, "probe bigint, node bigint, score double").filter(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "node"))
    return found.withColumn("r", rank).filter(F.col("r") <= neighbours).select("probe", "node")


def reach_for(positions: DataFrame, nodes: DataFrame, neighbours: int, probes: int = PROBES, target: float = TARGET) -> int:
    """How far along the curves, in rows, the share ``target`` of the true neighbours of a few queries lies on the nearest curve."""
    some = nodes.filter("asked").orderBy(F.xxhash64("node")).select("node", "vector").limit(probes).collect()
    ids, vectors = np.array([r["node"] for r in some]), np.array([r["vector"] for r in some])
    near = _true_neighbours(nodes, vectors, ids, neighbours).toPandas()
    if not len(near):
        return 1
    wanted = positions.sparkSession.createDataFrame(pd.DataFrame({"node": np.unique(np.concatenate([near["node"].to_numpy(), ids]))}))
    at = positions.join(F.broadcast(wanted), "node").toPandas()
    asks = at[at.asks == 1].rename(columns={"node": "probe", "pos": "from"})[["curve", "probe", "from"]]
    far = near.merge(at[at.asks == 0], on="node").merge(asks, on=["curve", "probe"])
    nearest = (far["pos"] - far["from"]).abs().groupby([far["probe"], far["node"]]).min()
    return max(1, int(np.ceil(nearest.quantile(target, interpolation="higher"))))


def nearest_neighbours(rows: DataFrame, column: str = "embedding", every: int = 20, neighbours: int = NEIGHBOURS, curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """For each row whose ``vec_id`` is divisible by ``every``: ``query_id, rank, vec_id, score`` of its nearest by inner product.

    Every vector has a place on several shifted Hilbert curves, sorted by ranges of keys. A query is compared with all vectors
    within a reach along each curve, in blocks of bounded size; the best of all curves are compared again in double precision. The
    reach is the one that finds 95 % of the true neighbours of 100 queries; where vectors have no structure that few dimensions show, it is a
    large share of the rows. Copies of a vector are one node and are told apart at the end, ties go to the smaller id. Null, zero
    and non-finite vectors and null ids take no part, repeated rows count once, no query or no vector gives no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    nodes = materialize(distinct_vectors(usable_vectors(rows, column), neighbours, every), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    longest = nodes.agg(F.sqrt(F.max(squares)).alias("m")).first()["m"]
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if longest is None or nodes.filter("asked").isEmpty():
        return empty
    means = nodes.select(F.posexplode("vector").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("k").collect()
    model = Curves(np.array([r["m"] for r in means] + [0.0]), float(np.sqrt(np.mean([r["s"] for r in means]))), curves, dims, bits)
    positions = materialize(_positions(_placed(nodes, model, longest)), "positions")
    reach = reach_for(positions, nodes, neighbours)
    size = int(np.clip(reach, LEAST_BLOCK, MOST_BLOCK))
    vectors = nodes.select("node", F.col("vector").cast("array<float>").alias("vector"))
    placed = positions.join(vectors, "node")
    blocks = placed.filter("asks = 0").select("curve", F.floor(F.col("pos") / size).alias("block"), "node", "vector")
    first, last = F.floor(F.greatest(F.col("pos") - reach, F.lit(0)) / size), F.floor((F.col("pos") + reach) / size)
    queries = placed.filter("asks = 1").select(
        F.col("curve").alias("on_curve"), F.explode(F.sequence(first, last)).alias("in_block"), F.col("node").alias("query"), F.col("vector").alias("asking")
    )
    keep = 2 * neighbours

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, node = np.stack(left["vector"].to_numpy()), left["node"].to_numpy()
        out = []
        for at in range(0, len(right), 512):
            part = right.iloc[at : at + 512]
            s = np.stack(part["asking"].to_numpy()) @ x.T
            top = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), top.shape[1]), "node": node[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel().astype(float)}))
        return pd.concat(out)

    found = blocks.groupBy("curve", "block").cogroup(queries.groupBy("on_curve", "in_block")).applyInPandas(compare, "query bigint, node bigint, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("r") <= keep).select("query", "node")
    exact = best.join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("asking")), "query").join(nodes.select("node", "vector", "ids"), "node")
    product = F.aggregate(F.zip_with("asking", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    listed = exact.select("query", product.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= neighbours + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    members = usable_vectors(rows, column).filter(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).distinct()
    asking = members.withColumnRenamed("vec_id", "query_id").join(nodes.select("h1", "h2", F.col("node").alias("query")), ["h1", "h2"])
    others = F.slice(F.filter("all", lambda x: x.vec_id != F.col("query_id")), 1, neighbours)
    return asking.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
