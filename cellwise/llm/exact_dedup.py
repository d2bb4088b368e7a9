"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so, each chunk gets an identifier that
is verified against the chunk's characters, and a text becomes the ordered list
of its chunk identifiers: its recipe. Texts are equal exactly if their recipes
are, so after the one pass that verifies identifiers no long text moves again;
grouping and joining carry recipes of eight bytes a chunk.

Verification: chunks are aggregated by (hash, chunk), with map-side combine, so
equal chunks travel once a task. A hash with one chunk is a sound identifier. If
any hash has two chunks, the texts that hold such a hash get identifiers that
also carry the chunk's rank among those of that hash.

Groups are counted with map-side combine. A group that holds more than a thousandth
of all rows is joined back by a broadcast of its single row, so a text that a third
of the rows repeat is never dealt to one task.

Defined results: a null text counts as empty, and an empty text has an empty
recipe, so all null and empty texts are equal. Null ``doc_id`` sorts after every
number; ``keep_id`` is null only if the whole group has none. Among rows that
repeat both ``doc_id`` and text exactly one is kept. An empty table gives an
empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.llm.common import materialize, spread_join, table, without

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends, between MIN_CHUNK and MAX_CHUNK characters from its start, after a full stop or a space that follows
#: one of these endings of words, or after one of these characters of scripts that don't part words. They are frequent in
#: Latin, Greek, Cyrillic, Hebrew, Arabic and Devanagari, and in Han, kana, Hangul and Thai writing.
ENDINGS = "er en ed re st la es os do ov ka ος αι το ов на ть ия ом ים ות של ات ية من في की का है में 니다 에서 는".split()
CHARACTERS = "的了是在のをはにกร"
BOUNDARY = rf"(?:(?<=[. ])(?<=(?:{'|'.join(ENDINGS)})[. ])|(?<=[{CHARACTERS}]))"
MIN_CHUNK, MAX_CHUNK = 512, 4096


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``row, doc_id, recipe, text_sha256`` for each row of ``docs``; written once. ``row`` tells rows apart."""
    # The text is named anew so that columns of the input can't clash.
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_norm"))
    cut = texts.select("doc_id", "_norm", chunks(F.col("_norm")).alias("_chunks"))
    plain = materialize(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.transform("_chunks", lambda c: _hash(c, hash_bits)).alias("recipe"),
            F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        ),
        "recipes",
    )
    known = (
        texts.select(F.explode(chunks(F.col("_norm"))).alias("chunk"))
        .select(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
        .groupBy("h", "chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    shared = known.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = materialize(shared, "collisions")
    if shared.isEmpty():
        return plain
    return _disambiguated(docs, known, shared, hash_bits)


def _disambiguated(docs: DataFrame, known: DataFrame, shared: DataFrame, hash_bits: int) -> DataFrame:
    """Recipes where hashes that stand for several chunks carry the chunk's rank as well."""
    ranks = known.join(shared, "h", "left_semi").select(
        "h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("rank")
    )
    rows = materialize(
        docs.select("doc_id", normalised(F.col("text")).alias("_norm")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "_norm"
        ),
        "rows",
    )
    placed = (
        rows.select("row", F.posexplode(chunks(F.col("_norm"))).alias("pos", "chunk"))
        .select("row", "pos", _hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
        .join(ranks, ["h", "chunk"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("a"))
        .select("row", F.flatten(F.transform("a", lambda x: F.array(x["h"], x["rank"].cast("long")))).alias("recipe"))
    )
    return materialize(
        rows.join(placed, "row", "left").select(
            "row",
            "doc_id",
            F.coalesce("recipe", F.array().cast("array<bigint>")).alias("recipe"),
            F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        ),
        "recipes",
    )


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays."""
    rows = recipes(docs, hash_bits)
    # The least doc_id's row stays, of several with it any one; without any id, the first row.
    groups = rows.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("_keep"),
        F.count(F.lit(1)).alias("_size"),
    )
    groups = materialize(groups, "groups")
    return spread_join(rows, groups, "recipe", "_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("_keep")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; documents are shuffled only if very many go."""
    copies = exact_groups(docs).filter("group_size > 1")
    keys = copies.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("n"))
    odd = keys.filter("n > 1 OR NOT _stays").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key"), "_stays")
    return without(docs, odd, F.sha2(normalised(F.col("text")).cast("binary"), 256))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
