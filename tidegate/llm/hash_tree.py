"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each node every child draws -ln(u) / weight, where u is a hash of the
row's key and the child's name in (0, 1), and the smallest draw wins: each child gets its share of
the weights. A child's draw falls with its own weight and does not depend on the others, so a
changed weight moves rows into or out of the changed subtree only, at each level of the tree.

Draws depend on the key and the tree alone, so rows need no shuffle to find their shards, and rows
of one key stay together. Column functions only.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; names of racks are unique, as are those of regions."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, grid: tuple[int, int, int] = (5, 2, 4)) -> list[Shard]:
    """The tree for so many shards: a grid of regions, racks and shards, as far as it goes.

    Every shard beyond the grid opens a region of its own. No other weight changes then, so the
    new shard takes rows from all others and no other shard takes any.
    """
    regions, racks, leaves = grid
    found = []
    for shard in range(shards):
        if shard < regions * racks * leaves:
            rack = shard // leaves
            found.append(Shard(f"region {rack // racks}", f"rack {rack}", shard))
        else:
            found.append(Shard(f"region of {shard}", f"rack of {shard}", shard))
    return found


def _draw(key: Column, child: Column, weight: Column) -> Column:
    # 53 bits of the hash, in the middle of their interval: never 0 or 1.
    bits = F.shiftrightunsigned(F.xxhash64(key, child), 11)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _pick(key: Column, children: Column) -> Column:
    """The name of the child with the smallest draw; of equal draws that with the smallest name."""
    draws = F.transform(
        children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))
    )
    return F.array_min(draws)["name"]


def _children(pairs: dict) -> Column:
    return F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"))
            for name, weight in pairs.items()
        )
    )


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a key. Shards without weight take nothing."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    leaves: dict[str, dict[int, float]] = {}
    for x in tree:
        if x.weight > 0:
            regions[x.region] = regions.get(x.region, 0.0) + x.weight
            own = racks.setdefault(x.region, {})
            own[x.rack] = own.get(x.rack, 0.0) + x.weight
            leaves.setdefault(x.rack, {})[x.shard] = x.weight
    if not regions:
        raise ValueError("A tree needs a shard with a weight.")

    def below(level: dict) -> Column:
        return F.create_map(*(c for name, kids in level.items() for c in (F.lit(name), _children(kids))))

    region = _pick(key, _children(regions))
    rack = _pick(key, F.element_at(below(racks), region))
    return _pick(key, F.element_at(below(leaves), rack))


def assign_shards(df: DataFrame, key: str, tree: Sequence[Shard], name: str = "shard") -> DataFrame:
    """The rows with a column ``name``: the shard of the column ``key``.

    Null keys are one more key. A column that has the name already is replaced.
    """
    return df.withColumn(name, shard_of(F.col(key), tree))


def number_slots(
    df: DataFrame, shard: str, order: Sequence[str], name: str = "slot", rows: int = 100_000
) -> DataFrame:
    """The rows with a column ``name``: a number from 0 without gaps within each shard.

    A shard's rows are dealt into buckets of about ``rows`` rows by a hash of the columns
    ``order``. Buckets are counted (one small row each), the counts before each are summed, and
    rows are numbered within their bucket, so no task holds more than some buckets, however few
    shards there are. Rows that agree in ``order`` are numbered in any order; rows without any
    difference share a bucket, so repeating a row without bound makes one bucket large.
    """
    counted = df.groupBy(shard).agg(F.count("*").alias("__rows"))
    sizes = counted.select(shard, F.ceil(F.col("__rows") / rows).cast("int").alias("__buckets"))
    bucket = F.pmod(F.xxhash64(*order), F.col("__buckets")).cast("int")
    dealt = df.join(F.broadcast(sizes), shard).withColumn("__bucket", bucket).drop("__buckets")
    counts = dealt.groupBy(shard, "__bucket").agg(F.count("*").alias("__rows"))
    before = F.expr(
        f"sum(__rows) OVER (PARTITION BY `{shard}` ORDER BY __bucket) - __rows"
    ).alias("__before")
    starts = counts.select(shard, "__bucket", before)
    inside = F.expr(
        f"row_number() OVER (PARTITION BY `{shard}`, __bucket ORDER BY {', '.join(order)}) - 1"
    )
    numbered = dealt.withColumn("__place", inside).join(starts, [shard, "__bucket"])
    return numbered.withColumn(name, F.col("__before") + F.col("__place")).drop(
        "__bucket", "__before", "__place"
    )
