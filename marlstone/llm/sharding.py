"""Sharding by a hierarchical weighted hash tree, with built-in functions only.

Each level (region, rack, shard) draws one weighted straw for every child, ln(u) / weight with u hashed from the key
and the child's name, and the longest straw wins. A weight that changes moves rows only into or out of its subtree.
grow() hangs a new shard under a region of its own, so that new shard is the only one that gains rows.

Null doc_id is a key like any other; null text has size 1 and crc32 0; repeated rows share a shard and get their own
slots. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int = 16, built: int = 16, region: int = 8, rack: int = 4) -> Tree:
    """The tree of so many shards, by their number alone: the first `built` in regions and racks, each later one in a
    region of its own. So tree(n + 1) is grow(tree(n)) from `built` on, and takes rows only into its new shard."""
    out: Tree = {}
    for s in range(min(shards, built)):
        out.setdefault(f"r{s // region}", {}).setdefault(f"k{s % region // rack}", {})[s] = 1.0
    for _ in range(built, shards):
        out = grow(out)
    return out


def grow(base: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: inside an old region it would take rows into its neighbours too."""
    new = 1 + max((s for racks in base.values() for shards in racks.values() for s in shards), default=-1)
    return {**base, f"own{new}": {"k0": {new: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _descend(key: Column, node: dict, path: str) -> Column:
    children = {c: n for c, n in node.items() if _weight(n) > 0}

    def result(name, child) -> Column:
        return _descend(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name))

    if len(children) == 1:
        return result(*next(iter(children.items())))
    straws = []
    for i, (name, child) in enumerate(children.items()):
        u = (F.xxhash64(key, F.lit(f"{path}/{name}")).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
        straws.append(F.struct((F.log(u) / F.lit(float(_weight(child)))).alias("straw"), F.lit(-i).alias("i")))
    won = F.greatest(*straws)["i"]
    out = F.when(won == 0, result(*next(iter(children.items()))))
    for i, (name, child) in enumerate(children.items()):
        if i:
            out = out.when(won == -i, result(name, child))
    return out


def shard_of(key: Column, nodes: Tree) -> Column:
    return _descend(key, nodes, "").cast("int")


def assign(docs: DataFrame, nodes: Tree, cell_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots are counted in two steps: inside cells (shard, hash of doc_id) of about cell_rows rows or less, then over the
    counts of the cells, so that no task holds a whole shard.
    """
    text = F.coalesce("text", F.lit(""))
    cells = max(8, docs.count() // cell_rows)
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, nodes).alias("shard"),
        F.pmod(F.xxhash64(key, F.lit("cell")), F.lit(cells)).alias("cell"),
        shard_of(key, grow(nodes)).alias("grown_shard"),
    )
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(first, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )
