"""Near-duplicate embeddings: random-hyperplane signatures, exact cosines, connected components.

Each of several tables gives a vector the signs of its products with random hyperplanes, as the
bits of a bucket. Two vectors of a cosine of ``threshold`` share a bucket of ``bits`` bits with
probability (1 - acos(threshold) / pi) ** bits, so as many tables are used as bring the chance of
missing such a pair below ``miss``. The number of bits follows the number of vectors, so buckets
stay small; a bucket that is large all the same is cut in blocks, and each pair of blocks is a
task's matrix product. A pair counts in the first table that it shares. A block returns the
number of links per vector and a spanning forest of its links, so that it never returns more rows
than it has vectors, however many links they have. Equal vectors are one vector here.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.components import connected_components, forest
from tidegate.llm.shared import stored

#: Vectors of a bucket that are compared at once.
BLOCK = 1024
SEED = 20


def plan(vectors: int, threshold: float, miss: float, per_bucket: int = 32) -> tuple[int, int]:
    """Bits and tables for so many different vectors."""
    bits = min(24, max(6, math.ceil(math.log2(max(vectors, 1) / per_bucket + 1))))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-shared))


def hyperplanes(dimension: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, bits * tables))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    planes = hyperplanes(vectors.shape[1], bits, tables)
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def usable(column: str) -> Column:
    """Whether a vector has a direction: not null or zero, all components finite numbers."""
    limit = F.lit(float("inf"))
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit)
    )
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled before they are squared, so no length over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _with_buckets(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    schema = "rep long, copies long, vector array<double>, buckets array<int>"

    def found(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            sizes = pc.list_value_length(batch.column("vector"))
            for size in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, size))
                buckets = signatures(_matrix(part.column("vector")), bits, tables)
                arrays = pa.array(list(buckets.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, arrays], names=[*part.schema.names, "buckets"]
                )

    return distinct.select("rep", "copies", "vector").mapInArrow(found, schema)


def _block_links(threshold: float):
    """Links within a block, or between the two blocks of a pair of blocks."""

    def found(key: tuple, table: pa.Table) -> pa.Table:
        at, left, right = (x.as_py() for x in key[0:1] + key[3:5])
        table = table.combine_chunks()
        rep = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        part = table.column("block").to_numpy()
        vectors = unit(_matrix(table.column("vector").chunk(0)).astype(np.float64))
        buckets = _matrix(table.column("buckets").chunk(0))
        i = np.flatnonzero(part == left)
        j = np.flatnonzero(part == right)
        linked = vectors[i] @ vectors[j].T >= threshold
        if left == right:
            linked = np.triu(linked, 1)
        x, y = np.nonzero(linked)
        x, y = i[x], j[y]
        if at:  # pairs that share an earlier table count there
            first = np.ones(len(x), bool)
            for t in range(at):
                first &= buckets[x, t] != buckets[y, t]
            x, y = x[first], y[first]
        links = np.bincount(x, copies[y], len(rep)) + np.bincount(y, copies[x], len(rep))
        tree = forest(x, y, len(rep))
        some = np.flatnonzero(links)
        a = np.concatenate([rep[some], rep[[p for p, _ in tree]]]) if len(tree) else rep[some]
        b = np.concatenate([rep[some], rep[[q for _, q in tree]]]) if len(tree) else rep[some]
        n = np.concatenate([links[some], np.zeros(len(tree))]).astype(np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": n})

    return found


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, miss: float = 0.0005, block: int = BLOCK
) -> DataFrame:
    """Per row ``(vec_id, n_links, component_id, kept)``: vectors linked by their cosine.

    ``embedding`` vectors of the same dimension link when their cosine in double precision is at
    least ``threshold``; a pair at the threshold is missed with probability ``miss``, a closer one
    less often, and no other pair links. ``n_links`` counts the other vectors linked directly,
    equal ones included. Null vectors, and those that are zero or hold a null, NaN or infinity,
    link with nothing. A null vec_id links with nothing and is its own, null, component. Rows that
    repeat a vec_id are vectors of their own with one id. Other columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.when(
            usable("embedding") & F.col("vec_id").isNotNull(),
            F.transform("embedding", lambda x: x.cast("double")),
        ).alias("vector"),
    )
    distinct = rows.filter("vector IS NOT NULL").groupBy("vector")
    distinct = distinct.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = stored(distinct, "vectors")
    bits, tables = plan(distinct.count(), threshold, miss)

    # Each vector once per table; a large bucket is cut in blocks by a hash of the vector's id.
    listed = stored(_with_buckets(distinct, bits, tables), "vector_buckets")
    listed = listed.withColumn("dimension", F.size("vector"))
    entries = listed.select("rep", "dimension", F.posexplode("buckets").alias("at", "bucket"))
    sizes = entries.groupBy("at", "bucket", "dimension").agg(F.count("*").alias("size"))
    sizes = sizes.filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / block))
    block_of = F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)").alias("block")
    own = listed.select("*", F.posexplode("buckets").alias("at", "bucket")).join(
        sizes.select("at", "bucket", "dimension", "blocks"), ["at", "bucket", "dimension"]
    )
    own = own.select("*", block_of)
    pairs = F.expr("""transform(sequence(0, CAST(blocks AS INT) - 1),
        o -> struct(least(o, block) AS left, greatest(o, block) AS right))""")
    placed = own.select("*", F.explode(pairs).alias("pair")).select(
        "at", "bucket", "dimension", F.col("pair.left").alias("left"),
        F.col("pair.right").alias("right"), "block", "rep", "copies", "vector", "buckets",
    )
    found = placed.groupBy("at", "bucket", "dimension", "left", "right").applyInArrow(
        _block_links(threshold), "a long, b long, links long"
    )
    found = stored(found, "vector_links")

    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    classes = (
        distinct.join(counts, "rep", "left")
        .join(component, "rep", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return rows.join(classes, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
