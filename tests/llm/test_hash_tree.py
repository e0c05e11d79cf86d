import math
import zlib

import xxhash

from sift.llm.hash_tree import hash_tree_shards, shard_of, standard_tree
from pyspark.sql import functions as F


def spark_hash(key: str, level: str, child: int) -> int:
    h = xxhash.xxh64(key.encode(), seed=42).intdigest()
    h = xxhash.xxh64(level.encode(), seed=h).intdigest()
    return xxhash.xxh64(child.to_bytes(4, "little"), seed=h).intdigest()


def brute(key, tree):
    draw = lambda level, c, w: -math.log(((spark_hash(key, level, c) >> 12) + 0.5) / 2 ** 52) / w
    total = lambda t: sum(map(total, t.values())) if isinstance(t, dict) else t
    for level in ("region", "rack", "shard"):
        c = min((c for c in tree if total(tree[c]) > 0), key=lambda c: draw(level, c, total(tree[c])))
        tree = tree[c]
    return c


def test_equals_brute_force(docs, rows):
    got = hash_tree_shards(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (brute(key, standard_tree(24)), brute(key, standard_tree(25)))
        assert r.grown_shard in (r.shard, 24)
    size = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == size
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_movement_stays_in_the_changed_subtree(spark):
    old, new = standard_tree(24), standard_tree(24)
    new[1][3] = {**new[1][3], 13: 3.0}  # one shard of region 1, rack 3 grows
    key = F.col("id").cast("string")
    moved = spark.range(20000).select(shard_of(key, old).alias("a"), shard_of(key, new).alias("b")).where("a <> b").collect()
    assert moved
    region = {s: r for r in new for rack in new[r] for s in new[r][rack]}
    rack = {s: k for r in new for k in new[r] for s in new[r][k]}
    for r in moved:  # into the subtrees whose weights grew: region 1; within it rack 3; within that shard 13
        assert region[r.b] == 1
        if region[r.a] == 1:
            assert rack[r.b] == 3
        if rack[r.a] == 3:
            assert r.b == 13


def test_empty(no_docs):
    assert hash_tree_shards(no_docs).count() == 0
