"""Shared plumbing: tables, row keys, joins that hot keys can't slow, and cutting lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.sources.shared import new_path, shared_dir, staged

__all__ = ["bounded", "discard", "let", "materialize", "new_path", "packed", "returning", "shared_dir", "spread_join", "table", "text_key", "without"]

#: Tables of this many rows at most are broadcast, once counted; beyond, a shuffle joins them.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in HOT_SHARE of the rows, so there are fewer hot keys than that.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows to the shared folder and read them back."""
    return staged(df, tag)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has no more than ``most`` rows; a shuffle joins it otherwise."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def spread_join(rows: DataFrame, single: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``single``, which holds one row for each ``key`` and, in ``size``, how many ``rows`` have it.

    Rows of hot keys, fewer than HOT_SHARE keys by their size, are joined where they
    are; the others are dealt by key. Null keys match nothing. ``size`` is left out.
    """
    hot = F.col(size) * HOT_SHARE > total
    few, many = F.broadcast(single.filter(hot).drop(size)), single.filter(~hot).drop(size)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``_row`` beside ``keys``, so that no name of the input can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *[value.alias(name) for name, value in keys.items()])


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null has a null key."""
    return F.unhex(F.md5(text.cast("binary")))


def without(docs: DataFrame, odd: DataFrame, key: Column) -> DataFrame:
    """``docs`` but for the rows that ``odd`` names, with all their columns.

    ``odd`` holds ``_id, _key, _stays``, a row for each ``doc_id`` and ``key`` of
    which rows go: all of them, or with ``_stays`` all but one. Nulls match nulls.
    Documents aren't shuffled where the keys can be broadcast, but for the rows of which one stays.
    """
    odd = materialize(odd, "odd")
    rows = packed(docs, _doc=F.col("doc_id"), _text=key)
    match = lambda r: rows["_doc"].eqNullSafe(r["_id"]) & rows["_text"].eqNullSafe(r["_key"])
    small = bounded(odd)
    left = rows.join(small, match(small), "left_anti").select("_row")
    one = bounded(odd.filter("_stays").drop("_stays"))
    if not odd.filter("_stays").isEmpty():
        again = rows.join(one, match(one), "left_semi")
        rank = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy(F.lit(0)))
        left = left.unionByName(again.withColumn("_again", rank).filter("_again = 1").select("_row"))
    return left.select("_row.*")


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, which gives freed memory back to the system after each task.

    Python workers outlive a stage. What their allocators would hold back for the next
    one lies idle beside the executor's heap, which the later stages fill.
    """

    def then_return(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return then_return


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/data/", 1)[0] for f in df.inputFiles() if "/data/" in f}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
