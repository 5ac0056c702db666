"""Merkle manifest of a dataset: one tree of hashes per source over its rows, and a tree over the sources.

Only every second level of nodes is stored, as one row for each aligned subtree of at most 256 nodes; the next stored level is computed
from these rows. A proof is extracted from the top down: the missing level inside a subtree is made again from its stored nodes, the
siblings on the way of each node are emitted, and the rest is discarded. So storage is a 255th more than the leaves, no task
ever holds more than one subtree, and a source with most of all rows is many subtrees like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Nodes that are hashed into one, and levels from one stored level to the next.
ARITY, LEVELS = 16, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``proof`` columns: of each level from the leaf on, the siblings to the left and to the right, joined.
PROOF = "array<struct<left: string, right: string>>"


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(framed, fields))


def lower_cased(text: Column) -> Column:
    """``text`` with A-Z lower-cased, as a change that a proof must show."""
    return F.translate(text, _UPPER, _LOWER)


def _numbered(df: DataFrame, group: str | None, order: Sequence[str], label: str) -> DataFrame:
    """Adds ``at``, the place from 0 among the rows of ``group`` by ``order`` (nulls first), and ``n``, the size of the group.

    Rows are range-partitioned over all groups together, so that a large group is spread out; what ties in full is spread by its place in
    the input. Each task numbers its rows, and only the sizes of groups in tasks are added up.
    """
    keys = [*([group] if group else []), *order]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id())
    columns = [F.col(k).asc_nulls_first() for k in keys]
    ranged = dealt.repartitionByRange(*columns, F.col("__tie").asc()).sortWithinPartitions(*columns, F.col("__tie").asc())
    placed = materialize(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33)), label)
    key = F.col(group) if group else F.lit(0)
    sizes = placed.groupBy(F.col("__task").alias("__of"), key.alias("__group")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy("__group")
    sizes = sizes.select(
        "__of", "__group",
        (F.sum("__size").over(whole.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"),
        F.sum("__size").over(whole).alias("n"), "__first",
    )
    met = placed.join(sizes, (F.col("__task") == F.col("__of")) & key.eqNullSafe(F.col("__group")))
    return met.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__at") - F.col("__first")).alias("at"), "n")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves."""
    out = F.lit(0)
    for k in range(15):
        out = F.when(n > ARITY**k, k + 1).otherwise(out)
    return out


def _level_above(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), ""), 256))


@dataclass
class Forest:
    """Trees by number: stored levels from the leaves up, and ``tree, n, node`` of their roots.

    A stored level has ``tree``, ``at`` (number of the subtree), ``n`` (leaves of the tree), ``steps`` (levels that it spans) and
    ``items``, its nodes in order with whatever else was given.
    """

    levels: list[DataFrame]
    roots: DataFrame


def _stored(nodes: DataFrame, level: int, every: int, label: str) -> DataFrame:
    """Subtrees of nodes ``tree, n, at, node`` and more at ``level``, written."""
    width = ARITY**every
    others = [c for c in nodes.columns if c not in ("tree", "n", "at")]
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / width).alias("at")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("at").alias("place"), *others))).alias("items")
    )
    steps = F.greatest(F.least(_height(F.col("n")) - level, F.lit(every)), F.lit(0))
    return materialize(grouped.withColumn("steps", steps), f"{label}-{level}")


def _interior(subtrees: DataFrame, every: int) -> DataFrame:
    """Adds ``level_0`` to ``level_k``: the nodes inside each subtree, level by level."""
    out = subtrees.withColumn("level_0", F.transform("items", lambda i: i.node))
    for k in range(every):
        out = out.withColumn(f"level_{k + 1}", _level_above(F.col(f"level_{k}")))
    return out


def build(nodes: DataFrame, most: int, label: str, every: int = LEVELS) -> Forest:
    """Trees over ``tree, n, at, node`` (and more): ``n`` leaves each, at most ``most``, numbered by ``at`` from 0. A tree of one leaf is that leaf."""
    levels, roots, level = [], None, 0
    while True:
        stored = _stored(nodes, level, every, label)
        levels.append(stored)
        inside = _interior(stored, every)
        top = F.coalesce(*(F.when(F.col("steps") == k, F.col(f"level_{k}")[0]) for k in range(every + 1)))
        made = inside.select("tree", "n", "at", top.alias("node"))
        level += every
        done = _height(F.col("n")) <= level
        ended = made.filter(done & (_height(F.col("n")) > (level - every if level > every else -1))).select("tree", "n", "node")
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= ARITY**level:
            return Forest(levels, materialize(roots, f"{label}-roots"))
        nodes = made.filter(~done)


def proofs(forest: Forest, above: DataFrame, label: str, every: int = LEVELS) -> DataFrame:
    """Every leaf with its proof: ``tree``, ``root`` and ``proof``, beside ``place``, ``node`` and what else the leaves had.

    ``above`` has the proof of each tree's root: ``tree, n, root, proof``, where ``proof`` goes on above the tree.
    """
    waiting = None
    for step in range(len(forest.levels) - 1, -1, -1):
        subtrees = _interior(forest.levels[step], every).drop("n")
        level = step * every
        height = _height(F.col("n"))
        ends = (height <= level + every) & (height > level if step else F.lit(True))
        parents = above.filter(ends).select("tree", F.lit(0).cast("bigint").alias("at"), "root", "proof")
        if waiting is not None:
            parents = parents.unionByName(waiting.select("tree", F.col("place").alias("at"), "root", "proof"))
        met = subtrees.join(parents.withColumnRenamed("proof", "upper"), ["tree", "at"])

        def siblings(j: Column, k: int) -> Column:
            """Siblings of the ancestor of node ``j``, ``k`` levels above it."""
            place = F.floor(j / ARITY**k).cast("int")
            first, nodes = place - place % ARITY, F.col(f"level_{k}")
            left = F.slice(nodes, first + 1, place - first)
            right = F.slice(nodes, place + 2, first + (ARITY - 1) - place)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        def path(j: Column, siblings=siblings) -> Column:
            return F.array(*(F.when(F.col("steps") > k, siblings(j, k)) for k in range(every)))

        ways = F.transform("items", lambda i, j: F.struct(i.alias("item"), path(j).alias("own")))
        each = met.select("tree", "root", "upper", F.explode(ways).alias("way"))
        own = F.filter("way.own", lambda level: level.isNotNull())
        waiting = each.select("tree", "root", "way.item.*", F.concat(own, "upper").cast(PROOF).alias("proof"))
        if step:
            waiting = materialize(waiting, f"{label}-{level}")
    return waiting


def folded(node: Column, proof: Column) -> Column:
    """The root that ``node`` and its proof lead to."""
    return F.aggregate(proof, node, lambda below, level: digest(level.left, below, level.right))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level.left, level.right)), ""), 256)


@dataclass
class Manifest:
    """``sources`` (the group's value, ``tree``, ``n``), the trees of the sources, and the tree over these; ``root`` is None for an empty dataset."""

    sources: DataFrame
    trees: Forest
    top: Forest
    root: str | None


def manifest(leaves: DataFrame, group: str = "source", order: Sequence[str] = ("doc_id",), every: int = LEVELS) -> Manifest:
    """The manifest of ``leaves``: ``group``, the columns of ``order``, ``node`` (the hash of a row), and others to be carried along.

    Leaves of a group come by ``order``, ties by their hash; null comes first, and null is a group of its own. Rows alike in all of these are alike in
    the tree, too. Clashing names can't do harm if ``leaves`` has none of ``tree``, ``at``, ``n``, ``place``.
    """
    leaves = materialize(leaves, "leaves")
    placed = _numbered(leaves, group, [*order, "node"], "placed")
    sources = placed.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    sources = materialize(_numbered(sources, None, [group], "sources").select(F.col(group).alias("__source"), F.col("at").alias("tree"), "size", F.col("n").alias("of")), "trees")
    first = placed.join(sources.select("__source", "tree"), F.col(group).eqNullSafe(F.col("__source"))).drop("__source")
    largest, many = sources.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("of"), F.lit(0))).first()
    trees = build(first, largest, "subtrees", every)
    roots = trees.roots.join(sources.select("tree", "of"), "tree").select(F.lit(0).alias("tree"), F.col("of").alias("n"), F.col("tree").alias("at"), "node")
    top = build(roots, many, "top", every)
    root = top.roots.first()
    return Manifest(sources.select(F.col("__source").alias(group), "tree", F.col("size").alias("n")), trees, top, root["node"] if root else None)


def extracted(made: Manifest, every: int = LEVELS) -> DataFrame:
    """A row per leaf: the columns given with it, ``node``, ``subroot`` (the root of its source's tree) and ``proof``."""
    start = made.top.roots.select("tree", "n", F.col("node").alias("root"), F.array().cast(PROOF).alias("proof"))
    subroots = proofs(made.top, start, "top-proofs", every)
    above = made.trees.roots.select("tree", "n").join(subroots.select(F.col("place").alias("tree"), F.col("node").alias("root"), "proof"), "tree")
    found = proofs(made.trees, materialize(above, "above"), "proofs", every)
    return found.drop("tree", "place").withColumnRenamed("root", "subroot")


def verified(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source") -> DataFrame:
    """Each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256``, and ``folded_root`` with ``verified``.

    Where ``tampered`` is true, ``text`` is lower-cased (A-Z) before the leaf is made again and folded with its proof; all else is untampered. Any column
    may be null. Repeated rows come out repeatedly, other columns than ``fields`` are ignored, an empty table gives no rows.
    """
    whole = [F.col(f) for f in fields]
    changed = [lower_cased(c) if f == "text" else c for f, c in zip(fields, whole, strict=True)]
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(changed)) if tampered is not None else F.lit(None).cast("string")
    made = manifest(docs.select(F.col(group).alias("source"), F.col("doc_id"), leaf(whole).alias("node"), other.alias("changed")))
    rows = extracted(made)
    root = folded(F.coalesce("changed", "node"), F.col("proof"))
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
