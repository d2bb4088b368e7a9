"""SimHash near-dedup: pigeonhole blocks, join on blocks, verified Hamming distance.

A 64-bit fingerprint is split into ``d + 2`` or more blocks, where ``d`` is the
number of bits in which linked fingerprints may differ. With ``b`` blocks a close
pair agrees in at least ``b - d`` of them, so every choice of ``b - d`` blocks
gives a join key, and pairs that share a key are verified. ``b`` follows the
number of distinct fingerprints so that a key has few of them; the links found
are the same for each ``b``.

Equal fingerprints are collapsed first. Keys with many fingerprints, as large
groups of near copies make them, never give all their pairs:

* up to SMALL fingerprints: joined with each other and verified;
* up to LARGE: one bounded group, searched breadth first, emits a spanning forest
  of its links (each fingerprint enters once);
* beyond: two fingerprints within 4 bits have a common neighbour within 2 bits of
  both. All such neighbours are listed, and every fingerprint that shares a
  neighbour links to the least one that does. This is exact and linear.

Components of the links then give each document its class.

Defined results: null, empty and blank texts have fingerprint zero, linked like
any other. Repeated rows are kept and share a class. A class without any non-null
``doc_id`` has a null ``component_id``. An empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import materialize, returning, spread_join, table, text_key, without
from cellwise.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
SMALL, LARGE = 32, 8192
#: Mean number of fingerprints to a key up to which no more blocks are taken.
PER_KEY = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, SEED), "big", signed=True)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    found = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    n = len(found) // 8
    counts = np.zeros(64, np.int64)
    hashes = np.frombuffer(found, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        counts += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp`` for each row; ``text_key`` tells texts of one ``doc_id`` apart."""
    rows = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = [fingerprint(texts[i].as_py(), shingle) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(returning(run), f"doc_id {kind}, text_key binary, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A mask of key bits for each choice of ``blocks - distance`` blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(parts, blocks - distance)]


def blocks_for(distinct: int, distance: int = DISTANCE) -> int:
    """The least number of blocks, at least two spare, whose keys are fine enough for so many fingerprints."""
    blocks = distance + 2
    while blocks < 2 * distance and distinct > PER_KEY * 2 ** ((blocks - distance) * 64 / blocks):
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    left, edges = fps.view(np.uint64), []  # the count of a signed number's bits would be that of its absolute value
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                edges.extend((int(at.view(np.int64)), int(x)) for x in found.view(np.int64))
                queue.extend(found)
                left = left[~near]
    return edges


def links(fps: DataFrame, distance: int = DISTANCE, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Edges ``a, b`` of fingerprints whose components are those of all links within ``distance`` bits.

    ``fps`` holds distinct fingerprints in ``fp`` and is read more than once.
    """
    masks = block_masks(blocks_for(fps.count(), distance), distance)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    members = fps.select("fp", F.posexplode(keys).alias("choice", "key"))
    buckets = members.groupBy("choice", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    buckets = materialize(buckets.filter("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    edges = buckets.filter("n = 2").filter(near).select("a", "b")

    crowded = materialize(members.join(buckets.filter("n > 2").select("choice", "key", "n"), ["choice", "key"]), "crowd")
    few = crowded.filter(F.col("n") <= small)
    # A pair is taken at the first key that it shares, so once only.
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key"))
              & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(apart) <= distance) & (first == F.col("x.choice")))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )

    def forest(group: pa.Table) -> pa.Table:
        found = _forest(np.unique(group.column("fp").to_numpy()), distance)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    many = crowded.filter((F.col("n") > small) & (F.col("n") <= large)).select("choice", "key", "fp")
    trees = many.groupBy("choice", "key").applyInArrow(forest, "a bigint, b bigint")
    beyond = crowded.filter(F.col("n") > large).select("fp").distinct()
    return edges.unionByName(pairs).unionByName(trees).unionByName(_by_neighbours(beyond, distance)).distinct()


def _by_neighbours(fps: DataFrame, distance: int) -> DataFrame:
    """Edges from each fingerprint to the least that shares a neighbour within half the distance of both."""
    flips = [0]
    for k in range(1, distance // 2 + 1):
        flips += [sum(1 << i for i in bits) for bits in combinations(range(64), k)]
    if distance % 2:  # an odd distance needs the next ball, and a look at the pairs' distance
        raise ValueError("the distance must be even")
    listed = F.lit(np.array([_signed(x) for x in flips], np.int64))
    around = fps.select("fp", F.explode(F.transform(listed, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = around.groupBy("z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return around.join(least, "z").filter("fp <> b").select(F.col("b").alias("a"), F.col("fp").alias("b")).distinct()


def near_groups(rows: DataFrame, distance: int = DISTANCE, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Adds ``component_id``, the least ``doc_id`` reachable, and ``root`` to rows with ``doc_id`` and ``fp``.

    ``root`` is the least fingerprint of the class, so it alone tells classes apart:
    ``component_id`` is null for each class without ids and shared where ids repeat.
    """
    single = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fps")
    total = single.agg(F.sum("n"), F.count("n")).first()
    roots = components(links(single.select("fp"), distance, small, large)).withColumnRenamed("node", "fp")
    known = single.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, "known")
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    classes = spread_join(known, lowest, "root", "fps", total[1] or 0).select("fp", "root", "component_id", "n")
    return spread_join(rows, materialize(classes, "classes"), "fp", "n", total[0] or 0)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` for each row of ``docs``."""
    return near_groups(materialize(fingerprints(docs, shingle), "fingerprints"), distance)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class stays, with all its columns: one with the class's least ``doc_id`` (null only without any).

    Classes are told apart by their root, so equal and null ids are no matter.
    """
    found = near_classes(docs)
    sizes = found.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.xxhash64("text_key"))).alias("first_key"),
        F.count(F.lit(1)).alias("size"),
    )
    sizes = materialize(sizes.filter("n > 1"), "sizes")
    copies = spread_join(found.drop("fp"), sizes, "root", "size", docs.count())
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.xxhash64("text_key") == F.col("first_key"))
    keys = copies.groupBy("doc_id", "text_key").agg(F.max(stays).alias("_stays"), F.count(F.lit(1)).alias("n"))
    odd = keys.filter("n > 1 OR NOT _stays").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_stays")
    return without(docs, odd, text_key(F.col("text")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
