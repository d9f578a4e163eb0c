"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.llm.common import text_or_empty

#: A tree: {region: {rack: {shard: weight}}}; a node weighs what its shards weigh together.
Tree = dict[int, dict[int, dict[int, float]]]


def even_tree(shards: int, racks: int = 2, shards_a_rack: int = 2) -> Tree:
    """A tree of equal shards, numbered from 0; a region holds racks * shards_a_rack of them."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = s // (racks * shards_a_rack), s // shards_a_rack % racks
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own.

    No other node's weight changes, so a row moves only if it draws the new region, and that holds nothing
    but the new shard.
    """
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, max(tree) + 1: {0: {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _straw(key: Column, label: str, weight: float) -> Column:
    """An exponential draw with rate weight: uniform from the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{label}")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))
    return -F.log(uniform) / F.lit(float(weight))


def _descend(key: Column, node, label: str) -> Column:
    """The shard that key reaches below node: at each level the child with the least draw, the first on a tie."""
    if not isinstance(node, dict):
        raise TypeError("a tree ends in {shard: weight}")
    children = sorted((k, v) for k, v in node.items() if _weight(v) > 0)
    below = [F.lit(int(k)) if not isinstance(v, dict) else _descend(key, v, f"{label}/{k}") for k, v in children]
    if len(children) == 1:
        return below[0]
    straws = [_straw(key, f"{label}/{k}", _weight(v)) for k, v in children]
    least = F.least(*straws)
    chosen = F.when(straws[0] <= least, below[0])
    for s, b in zip(straws[1:], below[1:]):
        chosen = chosen.when(s <= least, b)
    return chosen


def shard_of(doc_id: Column, tree: Tree) -> Column:
    """Shard of a row: doc_id and the tree alone decide. A null doc_id draws as the text 'null'.

    Draws are independent between nodes and each child's is scaled by its weight, so when a weight grows,
    rows move only into subtrees whose weight grew, and out of others in proportion.
    """
    return _descend(F.coalesce(doc_id.cast("string"), F.lit("null")), tree, "t").cast("int")


def assign_shards(docs: DataFrame, tree: Tree, larger: Tree | None = None, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    size is the text's bytes and one more (null text: none, so 1). slot numbers a shard's rows without gaps
    from 0, by block of the id's MD5, MD5, doc_id and checksum. A shard may hold a large share of all rows,
    so ranks are taken within blocks (shards * blocks groups, blocks at least the session's shuffle
    partitions), and the blocks' counts give where each begins. Only ids and checksums are shuffled, never
    texts. Repeated rows get slots of their own; other columns are ignored.
    """
    blocks = blocks or 256
    tiny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("_md5"),
    )
    placed = tiny.withColumn("shard", shard_of(F.col("doc_id"), tree)).withColumn("grown_shard", shard_of(F.col("doc_id"), larger) if larger else F.lit(None).cast("int"))
    digits = max(1, math.ceil(math.log(blocks, 16)))
    placed = placed.withColumn("_block", F.substring("_md5", 1, digits))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    # one row for each shard and block: bounded by the parameters
    first = counts.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_md5", F.asc_nulls_last("doc_id"), "size", "text_crc32")) - 1
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(first), ["shard", "_block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
    )


def oracle(shards: int = 8) -> str:
    """DuckDB SQL for the rows of op7: the same draws by MD5, and a table-driven crc32."""
    def straw(label, weight):
        return f"-ln((('0x' || substr(md5(k || ':{label}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)}) / {float(weight)}"

    def descend(node, label):
        children = sorted(node.items())
        below = [str(k) if not isinstance(v, dict) else descend(v, f"{label}/{k}") for k, v in children]
        if len(children) == 1:
            return below[0]
        straws = [straw(f"{label}/{k}", _weight(v)) for k, v in children]
        least = f"least({', '.join(straws)})"
        return "CASE " + " ".join(f"WHEN {s} <= {least} THEN {b}" for s, b in zip(straws, below)) + " END"

    tree = even_tree(shards)
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    table = f"(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step}) ORDER BY i) FROM range(256) r(i))"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
), tab AS (SELECT {table} AS crc), c AS (
  SELECT doc_id, k, strlen(t)::BIGINT + 1 AS size, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, tab.crc[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM d, tab
), p AS (SELECT *, ({descend(tree, "t")})::INTEGER AS shard, ({descend(grown(tree), "t")})::INTEGER AS grown_shard FROM c)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id NULLS LAST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM p"""
