"""Operator 1: a hierarchical weighted hash tree puts rows into shards.

A key descends region, rack and shard levels. At each node every child draws -ln(u) / weight with u
hashed from the key and the child's own name, and the least draw wins, so a child wins in proportion to
its weight (that of its subtree). A child's draw depends on nothing but its name and weight: changing a
weight moves keys only between that child and its siblings, adding a child moves keys only into it, and
nothing moves below nodes whose weights stayed. `ShardTree.grow` brings a shard up as a region of its
own, so the only changed weight is the new region's and keys move into the new shard alone.

Defined results: a null key is a key of its own; equal keys share a shard; null text has size 1 and CRC
0; repeated rows get slots of their own; an empty table gives an empty result; columns of the input
that bear a name of the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None


def _group(name: str, children: list[Node]) -> Node:
    return Node(name, sum(x.weight for x in children), tuple(children))


@dataclass(frozen=True)
class ShardTree:
    regions: tuple[Node, ...]

    @staticmethod
    def uniform(regions: int = 2, racks: int = 2, shards: int = 2, weight: float = 1.0) -> ShardTree:
        out = []
        for r in range(regions):
            rack = []
            for k in range(racks):
                ids = [(r * racks + k) * shards + s for s in range(shards)]
                rack.append(_group(f"r{r}/k{k}", [Node(f"r{r}/k{k}/s{i}", weight, shard=i) for i in ids]))
            out.append(_group(f"r{r}", rack))
        return ShardTree(tuple(out))

    def shards(self) -> int:
        return sum(len(rack.children) for region in self.regions for rack in region.children)

    def grow(self, weight: float = 1.0) -> ShardTree:
        """One more shard, numbered after the last, in a rack and a region of its own."""
        r, i = len(self.regions), self.shards()
        leaf = Node(f"r{r}/k0/s{i}", weight, shard=i)
        return ShardTree((*self.regions, _group(f"r{r}", [_group(f"r{r}/k0", [leaf])])))

    def place(self, key: Column) -> Column:
        """The shard of a key (a string column)."""
        return _descend(key, self.regions)


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("/" + node.name))), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / node.weight


def _descend(key: Column, nodes: tuple[Node, ...]) -> Column:
    if len(nodes) == 1:
        below = nodes[0]
        return F.lit(below.shard) if below.shard is not None else _descend(key, below.children)
    live = [x for x in nodes if x.weight > 0]
    best = F.array_min(F.array(*(F.struct(_draw(key, x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(live)))).getField("i")
    if all(x.shard is not None for x in live):
        return F.element_at(F.array(*(F.lit(x.shard) for x in live)), best + 1)
    out = None
    for i, x in enumerate(live[:-1]):
        to = _descend(key, x.children)
        out = F.when(best == i, to) if out is None else out.when(best == i, to)
    return out.otherwise(_descend(key, live[-1].children))


def key_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))


def assign(df: DataFrame, key: str, tree: ShardTree) -> DataFrame:
    """Adds `shard` and `grown_shard` (with one more shard)."""
    k = key_of(F.col(key))
    return df.withColumn("shard", tree.place(k)).withColumn("grown_shard", tree.grow().place(k))


def number(df: DataFrame, group: str, key: str, ties: list[str], out: str = "slot") -> DataFrame:
    """Adds gapless positions from 0 within each group, in the order of the key's hash.

    The hash's top 12 bits cut each group into 4096 cells; rows are numbered within their cell and cells
    offset by the counts before them, so no task holds more of a group than one cell."""
    h, cell, n, rank, before = (fresh_name(df, x) for x in ("h", "cell", "n", "rank", "before"))
    # hashes are signed, and so are cells: both sort alike
    hashed = df.withColumn(h, F.xxhash64(key_of(F.col(f"`{key}`")))).withColumn(cell, F.shiftright(h, 52).cast("int"))
    cells = hashed.groupBy(group, cell).agg(F.count(F.lit(1)).alias(n))
    ahead = F.sum(n).over(Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(group, cell, F.coalesce(ahead, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(group, cell).orderBy(h, key, *ties))
    rows = hashed.withColumn(rank, place.cast("long")).join(cells, [group, cell])
    return rows.withColumn(out, F.col(before) + F.col(rank) - 1).drop(h, cell, rank, before)


def shard_rows(docs: DataFrame, tree: ShardTree, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Size, checksum, shards and slot of every row, with the columns of `keep`."""
    keep = [c for c in (keep or [key]) if c not in {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}]
    rows = docs.select(
        *dict.fromkeys([key, *keep]),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = assign(rows.withColumn("law", F.lit("key")), key, tree)
    return number(rows, "shard", key, ["size", "text_crc32"])


def write_shards(docs: DataFrame, path: str, tree: ShardTree, key: str = "doc_id") -> None:
    """Writes the documents as one folder per shard."""
    docs.withColumn("shard", tree.place(key_of(F.col(key)))).write.partitionBy("shard").parquet(path)
