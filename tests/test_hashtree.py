"""The stored tree against manifests and diffs taken from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from provenir.operators import hashtree, provenance
from provenir.session import scratch_path

SCHEMA = "collection string, id string, hash string"


def fresh_digests(rows, spark, digits):
    roots = provenance.tree_hash(spark.createDataFrame(sorted((c, i, h) for (c, i), h in rows.items()), SCHEMA), ["collection"], digits)
    return {r.collection: r.hash for r in provenance.with_root(roots, spark, 0).collect()}


def digests(tree, version=None):
    return {r.collection: r.hash for r in tree.manifest(version).collect()}


def differences(df):
    return sorted((r.collection, r.id, r.old_hash, r.new_hash, r.change) for r in df.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_updates_touch_their_buckets_only(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(hashtree, "MAX_BROADCAST_KEYS", 0)
    rng = random.Random(3)
    held = {(rng.choice(provenance.COLLECTIONS), f"id{i}"): f"h{i}" for i in range(900)}
    states = [dict(held)]
    tree = hashtree.HashTree(spark, scratch_path(spark, "tree"), digits=3)
    assert tree.update(spark.createDataFrame([(c, i, h) for (c, i), h in held.items()], SCHEMA)) == 0
    # About one in a hundred: changed, removed and new objects, and one that stays as it was.
    keys = sorted(held)
    changes = {k: f"new-{k[1]}" for k in rng.sample(keys, 4)} | {k: None for k in rng.sample(keys, 3)} | {("entities", "extra"): "x", keys[0]: held[keys[0]]}
    assert tree.update(spark.createDataFrame([(c, i, h) for (c, i), h in changes.items()], SCHEMA)) == 1
    held = {k: v for k, v in (held | changes).items() if v is not None}
    states.append(dict(held))
    touched = tree.state(1).nodes.where("version = 1")
    assert touched.where("depth = 3").count() <= len(changes) and touched.count() <= len(changes) * 4
    # A collection goes altogether.
    gone = [k for k in held if k[0] == "hypotheses"]
    tree.update(spark.createDataFrame([(c, i, None) for c, i in gone], SCHEMA))
    held = {k: v for k, v in held.items() if k not in gone}
    states.append(dict(held))
    for version, state in enumerate(states):
        assert digests(tree, version) == fresh_digests(state, spark, 3)
    assert digests(tree) == digests(tree, 2)
    for a in range(3):
        for b in range(3):
            old, new = states[a], states[b]
            want = [(c, i, old.get((c, i)), new.get((c, i)), "added" if (c, i) not in old else "removed" if (c, i) not in new else "changed")
                    for c, i in {*old, *new} if old.get((c, i)) != new.get((c, i))]
            assert differences(hashtree.diff(tree.state(a), tree.state(b))) == sorted(want, key=lambda r: r[:2])


def test_comparison_descends_where_nodes_differ(spark, monkeypatch):
    """One changed object among many: one differing node a level, and one leaf of objects."""
    rows = [("entities", f"id{i}", f"h{i}") for i in range(3000)]
    tree = hashtree.HashTree(spark, scratch_path(spark, "tree"))
    tree.update(spark.createDataFrame(rows, SCHEMA))
    tree.update(spark.createDataFrame([("entities", "id7", "other")], SCHEMA))
    seen = []
    real = hashtree.cut_counted
    monkeypatch.setattr(hashtree, "cut_counted", lambda df, label="stage": (lambda r: (seen.append(r[1]), r)[1])(real(df, label)))
    assert differences(hashtree.diff(tree.state(0), tree.state(1))) == [("entities", "id7", "h7", "other", "changed")]
    assert seen == [1] * 5
    assert hashtree.diff(tree.state(1), tree.state()).count() == 0 and seen[5:] == [0]
    shallow = hashtree.HashTree(spark, scratch_path(spark, "tree"), digits=2)
    with pytest.raises(ValueError):
        hashtree.diff(tree.state(), shallow.state())


def test_empty_trees(spark):
    tree = hashtree.HashTree(spark, scratch_path(spark, "tree"), digits=2)
    none = spark.createDataFrame([], SCHEMA)
    tree.update(none)
    assert digests(tree) == fresh_digests({}, spark, 2)
    assert hashtree.diff(tree.state(), tree.state()).count() == 0
    one = spark.createDataFrame([("entities", "a", "h")], SCHEMA)
    moved = hashtree.changes_between(none, one)
    assert [tuple(r) for r in moved.collect()] == [("entities", "a", "h")]
    assert [r.hash for r in hashtree.changes_between(one, none).collect()] == [None]
    assert hashtree.changes_between(one, one.withColumn("hash", F.lit("h"))).count() == 0


def test_leaves_deal_digests_as_bytes_and_sort_them_as_texts(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from provenir.operators import provenance

    ids = ["0f" * 32, "zz", "F" * 64, "é", "1", ""]
    rows = spark.createDataFrame([(i, h) for i, h in zip(ids, reversed(ids))], "id string, hash string")
    leaf = provenance.leaf_hash(rows.withColumn("c", F.lit("x")), ["c"])
    want = json.dumps(sorted(map(list, zip(ids, reversed(ids))), key=lambda p: p[0].encode()), separators=(",", ":"))
    assert leaf.first()["hash"] == hashlib.sha256(want.encode()).hexdigest()
    assert "01" in leaf._jdf.queryExecution().optimizedPlan().toString() and "unhex" in leaf._jdf.queryExecution().optimizedPlan().toString()
