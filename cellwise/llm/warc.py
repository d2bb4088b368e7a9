"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

Writing. Records are text: header lines, a blank line, the block, and two line
ends. The text writer adds one final line feed to each value, so the value holds
everything but that byte, and a part file is a plain WARC file byte for byte. A
``revisit`` record refers to the response with the same payload and leaves the
payload out; which rows revisit is settled on digests, so only digests are grouped.

Reading. Files are cut at the magic ``WARC/1.0`` and not at record ends, by the
text reader with the magic as separator, so a file of any size is read in splits.
(The archives aren't compressed: a compressed file can't be split.)
A magic inside a payload therefore makes a false candidate. The pieces tile a
file: a piece's offset is the sum of the lengths before it, from sums within a
split and sums over splits. From its own ``Content-Length`` each candidate gives
the offset at which its successor would start. Within a split a task follows these
offsets to where each candidate's chain leaves the split. Only candidates at such
exits can be entered from another split, so the pointers that are left are a few a
split: pointer jumping from offset 0, with strides that double, keeps the entries
that are reached, and the tasks then follow the chains from these. Pieces
between two records are parts of one payload and are joined again.

Bytes that nothing reaches, such as a broken tail, belong to no record; a warning
tells how many there are, and the round trip of an archive written here fails on any.

Defined results: a null html is an empty payload. Null ``page_id`` makes a
response whose id is null. Rows that tie for the largest ``page_id`` of equal
payloads are all responses. Repeated ids are told apart by payload. Repeated rows
give repeated records and rows. Empty tables give an empty archive and result.
Columns other than ``page_id, url, html`` are ignored, whatever their names. Control
characters, spaces and other separators in a url are percent-encoded; a null url is
written as ``urn:none``. An id that isn't a number is percent-encoded, too.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.llm.common import bounded, discard, materialize, new_path, table

# Fixed values of the WARC 1.0 format.
MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this size are never revisited.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: What may not stand in a header's value: controls, white space and separators.
ODD = r"[\p{Cc}\p{Z}]"


def _digest(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _encoded(value: Column) -> Column:
    """The value with controls and separators percent-encoded as UTF-8."""
    one = lambda c: F.when(c.rlike(ODD), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c)
    return F.when(value.rlike(ODD), F.array_join(F.transform(F.split(value, ""), one), "")).otherwise(value)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``record``: the WARC record of each row, without its last line feed."""
    rows = pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", "html", F.octet_length("html").alias("bytes"), _digest(F.col("html")).alias("digest")
    )
    # Only digests that occur more than once can make a revisit.
    shared = (
        rows.filter(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "bytes", "first_id")
    )
    joined = rows.join(bounded(materialize(shared, "digests")), ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first_id"), F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    url = _encoded(F.coalesce("url", F.lit("urn:none")))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.url_encode(_text(F.col("page_id"))), F.lit(">"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: <urn:page:"),
            F.url_encode(_text(F.col("first_id"))), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Length: "), block_bytes.cast("string"), F.lit(CRLF + CRLF),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return joined.select(F.concat(header, body, F.lit(CRLF + "\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> str:
    """Write the rows of ``pages`` as WARC files under ``path``; one file a task."""
    records(pages, least_bytes).write.option("lineSep", "\n").text(path)
    return path


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, value``: what follows each magic, in the order of the split."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value"),
            F.octet_length("value").alias("bytes"),
        )
    )


def _in_splits(rows: DataFrame, extra: str, follow) -> DataFrame:
    """Rows of ``_pieces`` with columns made by ``follow(split)`` from the lists of a split's columns.

    A task reads a split in order; its columns but for payloads are held until it ends.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    part = batch.slice(start, i - start)
                    if held and (held[-1].column(0)[0], held[-1].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                        yield from follow(held)
                        held = []
                    held.append(part)
                    start = i
        if held:
            yield from follow(held)

    return rows.select(*names).mapInArrow(run, f"{kinds}, {extra}")


def _chains(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``within, hop, leaves``: offsets in the split of a piece, its successor and its chain's way out."""
    table = pa.Table.from_batches(held)
    sizes, heads, lengths = (table.column(c).to_pylist() for c in ("bytes", "head_bytes", "length"))
    within, hop, total = [], [], 0
    for n, head, length in zip(sizes, heads, lengths, strict=True):
        within.append(total)
        hop.append(None if length is None else total + len(MAGIC) + head + length + 4)
        total += n + len(MAGIC)
    place = {w: i for i, w in enumerate(within)}
    leaves: list[int | None] = [None] * len(within)
    for i in range(len(within) - 1, -1, -1):
        after = place.get(hop[i])
        leaves[i] = hop[i] if after is None or hop[after] is None else leaves[after]
    for name, values in (("within", within), ("hop", hop), ("leaves", leaves)):
        table = table.append_column(name, pa.array(values, pa.int64()))
    yield from table.combine_chunks().to_batches()


def _within(rows: DataFrame) -> DataFrame:
    """Adds ``within``, the offset in the split, to rows of ``_pieces``, passing payloads on batch by batch."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        total = 0
        for batch in batches:
            starts = []
            columns = [batch.column(c).to_pylist() for c in ("file", "split", "bytes")]
            for file, split, n in zip(*columns, strict=True):
                if (file, split) != at:
                    at, total = (file, split), 0
                starts.append(total)
                total += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "within"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{kinds}, within bigint")


def _bases(placed: DataFrame) -> DataFrame:
    """``file, split, base``: the offset in its file at which the pieces of a split begin, and ``size`` of them."""
    ends = placed.groupBy("file", "split").agg(F.max(F.col("within") + F.col("bytes") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # The first piece of a file ends where the first magic begins, so the piece itself starts one magic earlier.
    base = F.coalesce(F.sum("size").over(before), F.lit(0)) - len(MAGIC)
    return ends.select("file", "split", base.alias("base"), "size")


def _field(head: Column, name: str) -> Column:
    """The value of a header field. Lines end with CRLF only: no other line end begins a field."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|\z)", 1)
    return F.when(found != "", found)


def _length(head: Column) -> Column:
    return F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|\z)", 1)


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pieces of all files without their payloads, and where each split begins.

    ``file, split, bytes, head_bytes, length, within, hop, leaves, start``: a piece
    without a header that gives its length is no candidate and has a null ``hop``.
    """
    head = F.substring_index("value", CRLF + CRLF, 1)
    # Only a piece whose header ends within it has one.
    length = F.when(F.octet_length(head) < F.col("bytes"), _length(head))
    narrow = _pieces(spark, path).select(
        "file", "split", "bytes", (F.octet_length(head) + 4).alias("head_bytes"),
        F.when(length != "", length.cast("bigint")).alias("length"),
    )
    placed = materialize(_in_splits(narrow, "within bigint, hop bigint, leaves bigint", _chains), "candidates")
    bases = materialize(_bases(placed), "splits")
    base = bounded(bases.drop("size"))
    return placed.join(base, ["file", "split"]).withColumn("start", F.col("base") + F.col("within")), bases


def reachable(edges: DataFrame) -> DataFrame:
    """The ``file, start`` of the chain from offset 0 of each file, by pointer jumping.

    ``edges`` holds ``file, start, next``. Each round joins the reached offsets
    with pointers of the present stride and then doubles the stride, so a chain of
    n pointers takes log2(n) rounds; rows stay as many as there are pointers.
    """
    jumps = materialize(edges.select("file", "start", "next"), "jumps")
    reached = materialize(jumps.filter("start = 0").select("file", "start"), "reached")
    count = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        ahead = ahead.join(edges.select("file", "start"), ["file", "start"], "left_semi")
        grown = materialize(reached.unionByName(ahead).distinct(), "reached")
        discard(reached)
        reached, last = grown, count
        count = reached.count()
        if count == last:
            discard(jumps)
            return reached
        hop = jumps.select(F.col("file"), F.col("start").alias("next"), F.col("next").alias("after"))
        doubled = jumps.join(hop, ["file", "next"]).select("file", "start", F.col("after").alias("next"))
        longer = materialize(doubled, "jumps")
        discard(jumps)
        jumps = longer


def _marked(group: pa.Table) -> pa.Table:
    """The pieces of a split that aren't whole records by themselves: ``file, start, next``; next is null but for records."""
    table = group.sort_by("within")
    columns = ("within", "hop", "entered", "whole")
    within, hop, entered, whole = (table.column(c).to_pylist() for c in columns)
    due: set[int] = set()
    odd, after = [], []
    for i, w in enumerate(within):
        reached = entered[i] or w in due
        if reached and hop[i] is not None:
            due.add(hop[i])
        else:
            reached = False
        if not (reached and whole[i]):
            odd.append(i)
            after.append(table.column("base")[i].as_py() + hop[i] if reached else None)
    found = table.select(["file", "start"]).take(pa.array(odd, pa.int64()))
    return found.append_column("next", pa.array(after, pa.int64()))


def verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """The pieces that aren't whole records by themselves, where splits begin, and by how many bytes records and files differ."""
    found, bases = candidates(spark, path)
    leaves = (F.col("base") + F.col("leaves")).alias("next")
    exits = found.filter("leaves IS NOT NULL").select("file", leaves.alias("start")).distinct()
    able = found.filter("hop IS NOT NULL").select("file", "start", leaves)
    entries = able.join(bounded(materialize(exits, "exits")), ["file", "start"], "left_semi").unionByName(able.filter("start = 0"))
    entries = materialize(entries.distinct(), "entries")
    reached = reachable(entries)
    ends = entries.join(reached, ["file", "start"], "left_semi").groupBy("file").agg(F.max("next").alias("end"))
    sizes = bases.groupBy("file").agg(F.max(F.col("base") + F.col("size")).alias("size"))
    # The last piece has no magic behind it and the first none before it, which the base counts already.
    lost = F.abs(F.col("size") - F.coalesce("end", F.lit(0)))
    unreached = sizes.join(ends, "file", "left").agg(F.sum(lost)).first()[0] or 0
    whole = F.coalesce(F.col("head_bytes") + F.col("length") <= F.col("bytes"), F.lit(False)).alias("whole")
    marks = found.join(bounded(reached.withColumn("entered", F.lit(True))), ["file", "start"], "left").select(
        "file", "split", "base", "start", "within", "hop", F.coalesce("entered", F.lit(False)).alias("entered"), whole
    )
    odd = marks.groupBy("file", "split").applyInArrow(_marked, "file string, start bigint, next bigint")
    return materialize(odd, "odd"), bases, int(unreached)


def read_archives(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``record_id, record_type, refers_to, target_uri, payload_digest, block`` of each verified record.

    ``block`` is binary; for responses it holds the HTTP header and the payload.
    Offsets are settled on headers alone. Payloads are then read once more and pass
    straight through where a piece is a whole record that is reached, as nearly all
    are; only the other pieces are looked up, and only those of torn records move.
    Bytes that no record reaches give a warning, or with ``strict`` a ValueError.
    """
    odd, bases, unreached = verified(spark, path)
    if unreached:
        said = f"{unreached} bytes of the archives under {path} belong to no record, or are missing from the last one"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    placed = _within(_pieces(spark, path)).join(bounded(bases.drop("size")), ["file", "split"])
    placed = placed.select("file", (F.col("base") + F.col("within")).alias("start"), "value")
    head = F.substring_index("value", CRLF + CRLF, 1)
    full = placed.join(bounded(odd.select("file", "start")), ["file", "start"], "left_anti").select(
        head.alias("head"), _cut(F.col("value").cast("binary"), F.octet_length(head) + 4, _length(head).cast("bigint")).alias("block")
    )
    # A torn record takes the pieces in its range; both sides are dealt by file and 1 MiB cell.
    cell = lambda c: F.shiftright(c, 20)
    torn = odd.filter("next IS NOT NULL")
    cells = torn.withColumn("cell", F.explode(F.sequence(cell("start"), cell("next"))))
    parts = placed.join(bounded(odd.select("file", "start")), ["file", "start"], "left_semi").select(
        F.col("file"), cell("start").alias("cell"), F.col("start").alias("at"), F.col("value").alias("piece")
    )
    parts = cells.join(parts, ["file", "cell"]).filter("at >= start AND at < next")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])
    mended = parts.groupBy("file", "start").agg(F.array_join(ordered, MAGIC).alias("value"))
    mended = mended.select(
        head.alias("head"), _cut(F.col("value").cast("binary"), F.octet_length(head) + 4, _length(head).cast("bigint")).alias("block")
    )
    return full.unionByName(mended).select(
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("payload_digest"),
        "block",
    )


def _cut(data: Column, start: Column | str, length: Column | str) -> Column:
    start, length = (F.col(x) if isinstance(x, str) else x for x in (start, length))
    return F.substring(data, (start + 1).cast("int"), length.cast("int"))


def payload(block: Column) -> Column:
    """What follows the HTTP header of a block."""
    head = F.octet_length(F.substring_index(block.cast("string"), CRLF + CRLF, 1))
    return _cut(block, head + 4, F.octet_length(block))


def round_trip(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` under ``path``, read the archives back and give one row per record.

    Size and digest are those of the payloads read; a revisit has them from the
    response with the id and the digest that it refers to, and none without it.
    """
    write_archives(pages, path, least_bytes)
    read = read_archives(pages.sparkSession, path, strict=True)
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.url_decode(F.expr(f"nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '')")).cast(kind)
    measured = read.select(
        number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("said"),
        F.octet_length(payload(F.col("block"))).cast("long").alias("bytes"), F.sha1(payload(F.col("block"))).alias("sha1"),
    )
    seen = materialize(measured, "records")
    revisits = seen.filter("record_type = 'revisit'").select("page_id", "refers_to", "said")
    # Equal digests have equal sizes, so any of the responses with an id and a digest will do.
    wanted = materialize(revisits.select("refers_to", "said").distinct(), "wanted")
    source = seen.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("sha1").alias("said"), "bytes")
    source = source.join(bounded(wanted), ["refers_to", "said"], "left_semi").groupBy("refers_to", "said").agg(F.max("bytes").alias("bytes"))
    direct = seen.filter("record_type <> 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"
    )
    again = revisits.join(bounded(materialize(source, "sources")), ["refers_to", "said"], "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.when(F.col("bytes").isNotNull(), F.col("said")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to",
    )
    return direct.unionByName(again)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last_id FROM d
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM m
"""
