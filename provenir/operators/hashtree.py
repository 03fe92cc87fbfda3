"""The tree manifest kept as a table: updated where objects changed, compared where nodes differ.

A version holds the objects that changed and the nodes that changed with them: a leaf
for every id bucket that a change touches, and its ancestors. Untouched buckets are
neither read through nor hashed again. Two states are compared from the root down;
children and at last objects are only looked up below nodes that differ.

The digests are those of ``provenance.tree_manifest`` with the same depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.operators import provenance
from provenir.operators.skew import MAX_BROADCAST_KEYS
from provenir.session import cut, cut_counted
from provenir.sources.tables import Deltas

SCHEMAS = {
    "objects": "collection string, prefix string, id string, hash string, version long",
    "nodes": "collection string, depth int, prefix string, hash string, version long",
}


def _few(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys


def _latest(rows: DataFrame, *key: str) -> DataFrame:
    """The newest hash of each key; null where the newest version removed it."""
    return rows.groupBy(*key).agg(F.max_by("hash", "version").alias("hash"))


@dataclass(frozen=True)
class State:
    """A tree as of one version."""

    objects: DataFrame
    nodes: DataFrame
    digits: int

    def level(self, depth: int, below: DataFrame | None = None, n: int = 0) -> DataFrame:
        """Nodes at ``depth``: ``collection, prefix, hash``; with ``below`` only children of those ``n`` nodes."""
        at = self.nodes.where(F.col("depth") == depth)
        if below is not None:
            up = _few(below.select("collection", F.col("prefix").alias("up")), n)
            at = at.withColumn("up", F.substring("prefix", 1, depth - 1)).join(up, ["collection", "up"], "left_semi")
        return _latest(at, "collection", "prefix").where("hash IS NOT NULL")

    def bucket_objects(self, leaves: DataFrame, n: int) -> DataFrame:
        """Objects of the ``n`` given leaves: ``collection, prefix, id, hash``."""
        near = self.objects.join(_few(leaves.select("collection", "prefix"), n), ["collection", "prefix"], "left_semi")
        return _latest(near, "collection", "prefix", "id").where("hash IS NOT NULL")


class HashTree:
    """A stored tree under ``root``; ids are unique within a collection."""

    def __init__(self, spark: SparkSession, root: str, digits: int = provenance.TREE_DIGITS):
        self.spark, self.digits, self.store = spark, digits, Deltas(spark, root, SCHEMAS)

    def state(self, version: int | None = None) -> State:
        """The tree as of ``version``, by default the newest."""
        held = self.store.read(None if version is None else version + 1)
        return State(held["objects"], held["nodes"], self.digits)

    def update(self, changes: DataFrame) -> int:
        """Take in ``collection, id, hash`` rows, hash null where the object is gone; returns the new version.

        The first update builds the tree. Leaves without a change keep their hash.
        """
        made = self.store.versions()
        version = made[-1] + 1 if made else 0
        prefix = F.substring(F.sha2("id", 256), 1, self.digits)
        changes = cut(changes.select("collection", prefix.alias("prefix"), "id", "hash", F.lit(version).cast("long").alias("version")), "changes")
        touched, n = cut_counted(changes.select("collection", "prefix").distinct(), "touched")
        before = self.state()
        objects = changes
        if made:
            near = before.objects.join(_few(touched, n), ["collection", "prefix"], "left_semi")
            objects = objects.unionByName(near)
        rows = _latest(objects, "collection", "prefix", "id").where("hash IS NOT NULL")
        changed = cut(touched.join(provenance.leaf_hash(rows, ["collection", "prefix"]), ["collection", "prefix"], "left"), "nodes")
        levels = [changed.withColumn("depth", F.lit(self.digits))]
        for depth in range(self.digits - 1, -1, -1):
            up: Column = F.substring("prefix", 1, depth)
            parents, n = cut_counted(changed.select("collection", up.alias("prefix")).distinct(), "touched")
            children = changed
            if made:
                beside = before.level(depth + 1, parents, n).join(changed.select("collection", "prefix"), ["collection", "prefix"], "left_anti")
                children = changed.unionByName(beside)
            joined = provenance.inner_hash(children.where("hash IS NOT NULL"), ["collection"], depth)
            changed = cut(parents.join(joined, ["collection", "prefix"], "left"), "nodes")
            levels.append(changed.withColumn("depth", F.lit(depth)))
        nodes = levels[0]
        for level in levels[1:]:
            nodes = nodes.unionByName(level)
        self.store.append(version, {"objects": changes, "nodes": nodes.select("collection", "depth", "prefix", "hash", F.lit(version).cast("long").alias("version"))})
        return version

    def manifest(self, version: int | None = None) -> DataFrame:
        """Collection digests and the ``manifest`` row, from the stored roots alone."""
        roots = self.state(version).level(0).select("collection", "hash")
        return provenance.with_root(roots, self.spark, provenance.TREE_VERSION + self.digits)


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn one set of ``collection, id, hash`` into another, for ``HashTree.update``."""
    old = before.select("collection", "id", F.col("hash").alias("old"))
    both = old.join(after.select("collection", "id", "hash"), ["collection", "id"], "full")
    return both.where("NOT (old <=> hash)").select("collection", "id", "hash")


def diff(before: State, after: State) -> DataFrame:
    """Objects that were added, removed or changed, as ``provenance.diff`` has them, by descending where nodes differ."""
    if before.digits != after.digits:
        raise ValueError("trees of different depth cannot be compared")
    differing, n = None, 0
    for depth in range(before.digits + 1):
        old = before.level(depth, differing, n).withColumnRenamed("hash", "old_hash")
        both = old.join(after.level(depth, differing, n), ["collection", "prefix"], "full")
        differing, n = cut_counted(both.where("NOT (old_hash <=> hash)").select("collection", "prefix"), "differing")
        if n == 0:
            break
    a = before.bucket_objects(differing, n).withColumnRenamed("hash", "old_hash")
    b = after.bucket_objects(differing, n).withColumnRenamed("hash", "new_hash")
    both = a.join(b, ["collection", "prefix", "id"], "full").drop("prefix")
    return both.withColumn("change", provenance.change_kind()).where("change IS NOT NULL")
