"""Operator 4: sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child makes
a weighted hash draw ``-ln(u) / weight`` with ``u`` hashed from the row id and
the child's place in the tree; the smallest draw wins.  Draws of a child depend
on nothing but the id and that child, so a changed weight moves rows only into
or out of the subtree whose weight changed.

Defined results: a null id is one id of its own; null text has size 8 and the
CRC of the empty text; repeated rows get slots of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .flow import null_safe, rank_within

RACKS, SHARDS = 3, 4  # racks in a region, shards in a rack, of the standard tree

Tree = dict[int, dict[int, dict[int, float]]]  # region -> rack -> shard -> weight


def standard_tree(n_shards: int) -> Tree:
    """Equal shards filled in order: four to a rack, three racks to a region.

    Twelve shards fill a region, so a shard added to full regions (as the 25th)
    opens a region of its own and takes rows only into itself; one added inside
    a region draws rows into that region's subtree.
    """
    tree: Tree = {}
    for s in range(n_shards):
        rack = s // SHARDS
        tree.setdefault(rack // RACKS, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    """Exponential draw with rate ``weight``; 52 hash bits, never 0 or 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 12).cast("double") + 0.5) / float(2 ** 52)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(child).alias("c"))


def _pick(key: Column, level: str, weights: dict[int, float]) -> Column:
    alive = {c: w for c, w in weights.items() if w > 0}
    if len(alive) == 1:
        return F.lit(next(iter(alive)))
    return F.least(*[_draw(key, level, c, w) for c, w in sorted(alive.items())])["c"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard id of a key as one expression over the whole tree (a subtree's weight is the sum of its shards')."""
    rack_w = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = _pick(key, "region", {r: sum(k.values()) for r, k in rack_w.items()})
    out = None
    for r, racks in sorted(tree.items()):
        inner = None
        rack = _pick(key, "rack", rack_w[r])
        for k, shards in sorted(racks.items()):
            if rack_w[r][k] > 0:
                leaf = _pick(key, "shard", shards)
                inner = F.when(rack == k, leaf) if inner is None else inner.when(rack == k, leaf)
        if inner is not None:
            out = F.when(region == r, inner) if out is None else out.when(region == r, inner)
    return out


def hash_tree_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                     tree: Tree | None = None, grown: Tree | None = None, buckets: int = 1024) -> DataFrame:
    """Shard, place in the shard and the shard after growth for every row of ``docs``.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard).  Text is read
    once into its size and CRC; only these narrow rows are shuffled for the slots.
    """
    text = null_safe(F.col(text_col))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, tree or standard_tree(n_shards)).cast("int").alias("shard"),
        shard_of(key, grown or standard_tree(n_shards + 1)).cast("int").alias("grown_shard"))
    ranked = rank_within(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", buckets)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
