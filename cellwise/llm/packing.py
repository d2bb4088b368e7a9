"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are encoded by byte-level BPE with the installed library; ids beyond a row's length are split off in whole rows, so no id
is lost. Segments are packed into rows of LENGTH ids, the longest first, each into
the row with the least room that still holds it. Rooms are leaves of a segment
tree over capacities, so the search takes log2(LENGTH) steps. Each task packs what
it reads in batches of BATCH_IDS ids: nothing is shuffled and memory is bounded. So the
packing depends on how the input is split, but not on anything else; each batch
wastes little more than its last row (README gives the share of padding).

Ids are those of the library on the whole text. Only a single run of more than PART
characters (of letters, digits, symbols or white space alone) is encoded in stretches,
which decode to the same text but may hold other ids where they meet.

A packed row has ``pack_id``; ``ids``, LENGTH little-endian numbers of ``id_bytes``
bytes, padded with ``pad_id``; ``cu_seqlens``, the cumulative segment lengths from 0
to the ids used; ``resets``, where positions start again from 0 (each segment's
first place, and the padding's); ``doc_ids`` and ``starts``, each segment's document
and its first id's place there. ``unpack`` gives the documents' ids back.

Defined results: null and empty texts have no ids, so they are in no row; an empty
table gives no rows. Null ``doc_id`` stays null. Repeated rows are packed each on
their own. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of words of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts of once to twice so many characters, cut where no token crosses.
PART = 100_000
LENGTH = 2048
BATCH_IDS = 1 << 22
#: Packed rows handed on at a time.
ROWS = 512

_WORDS = re.compile(r"[^\W\d_] (?=[^\W\d_])")
_PIECES = regex.compile(PATTERN)


def _part_end(text: str, at: int) -> int:
    """Where a part that begins at ``at`` ends."""
    most = at + 2 * PART
    if len(text) <= most:
        return len(text)
    cut = _WORDS.search(text, at + PART, most)
    if cut:
        return cut.start() + 1
    last = at
    for piece in _PIECES.finditer(text, at, most):
        # A piece at the end of the stretch may go on, and white space depends on what follows it.
        if piece.end() < most - 3 and not text[piece.end() - 1].isspace():
            last = piece.end()
    return last if last > at else most


class Vocabulary:
    """Byte strings by rank from a file; of fixed size, so it is broadcast. The encoder is made by each worker."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks}

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        found, at = [], 0
        while at < len(text):
            end = _part_end(text, at)
            found.append(self.encoding.encode_to_numpy(text[at:end]))
            at = end
        return found[0] if len(found) == 1 else np.concatenate(found)

    def decode(self, ids) -> str:
        return self.encoding.decode([int(i) for i in ids])


class Rooms:
    """Open rows by room left; ``take`` finds the least room that is at least so large."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """``room, row``, removed; None if no open row has so much room."""
        tree, at = self.tree, self.size + least
        if not tree[at]:
            # Up to the first right neighbour that holds a room, then down its left edge.
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not tree[2 * at])
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            tree[at] = 0
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = 0
                at >>= 1
        return room, row


def best_fit(lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """Rows of segment numbers; lengths are from 1 to ``length``. Of equal segments the first goes first."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[i])
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return rows


def _packed(segments: list[tuple], length: int, dtype: str, pad: int, prefix: str) -> Iterator[dict]:
    """Packed rows of ``(doc_id, start, ids)`` segments."""
    for n, row in enumerate(best_fit([len(s[2]) for s in segments], length)):
        ends = np.cumsum([len(segments[i][2]) for i in row])
        ids = np.full(length, pad, dtype)
        ids[: ends[-1]] = np.concatenate([segments[i][2] for i in row])
        lengths = [0, *ends.tolist()]
        yield {
            "pack_id": f"{prefix}-{n}",
            "ids": ids.tobytes(),
            "cu_seqlens": lengths,
            "resets": lengths if ends[-1] < length else lengths[:-1],
            "doc_ids": [segments[i][0] for i in row],
            "starts": [segments[i][1] for i in row],
        }


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, pad_id: int = 0, batch_ids: int = BATCH_IDS) -> DataFrame:
    """The packed rows of all texts of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id"), F.col("text").alias("_whole_text"))
    width = 2 if max(vocabulary.ranks.values()) < 1 << 16 else 4
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"pack_id string, id_bytes int, ids binary, cu_seqlens array<int>, resets array<int>, "
        f"doc_ids array<{kind}>, starts array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        task = TaskContext.get().partitionId()
        segments, size, turn = [], 0, 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for row in _packed(segments, length, f"<u{width}", pad_id, f"{task}-{turn}"):
                held.append(row)
                if len(held) == ROWS:
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

        def batch_of(held: list[dict]) -> pa.RecordBatch:
            of = lambda name, t: pa.array([r[name] for r in held], t)
            arrays = [
                of("pack_id", pa.string()), pa.array([width] * len(held), pa.int32()), of("ids", pa.binary()),
                of("cu_seqlens", pa.list_(pa.int32())), of("resets", pa.list_(pa.int32())),
                of("doc_ids", pa.list_(id_type)), of("starts", pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(
                arrays, ["pack_id", "id_bytes", "ids", "cu_seqlens", "resets", "doc_ids", "starts"]
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()).astype(f"<u{width}")
                doc = doc.as_py()
                for at in range(0, len(ids), length):
                    segments.append((doc, at, ids[at : at + length]))
                    size += len(segments[-1][2])
                    if size >= batch_ids:
                        yield from flush()
                        segments, size, turn = [], 0, turn + 1
        if segments:
            yield from flush()

    return rows.mapInArrow(run, schema)


def unpack(rows: list) -> dict:
    """Ids by ``doc_id`` from packed rows; for documents whose ids are told apart by ``doc_id``."""
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts[doc].append((start, ids[a:b]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda x: x[0])]) for d, p in parts.items()}


def write_matrices(rows: DataFrame, path: str, rows_a_matrix: int = ROWS) -> None:
    """Write packed rows as matrices of up to ``rows_a_matrix`` rows, Parquet files under ``path``.

    A matrix has ``n_rows, width, id_bytes``, ``ids`` (all rows one after another,
    little-endian), ``cu_seqlens`` (cumulative segment lengths over the whole matrix,
    padding being a segment too), ``resets`` (places in the matrix at which positions
    start again), and ``pack_ids, doc_ids, starts`` by row. No rows give no matrices.
    """
    kind = rows.schema["doc_ids"].dataType.simpleString()
    schema = (
        "n_rows int, width int, id_bytes int, ids binary, cu_seqlens array<bigint>, resets array<bigint>, "
        f"pack_ids array<string>, doc_ids array<{kind}>, starts array<array<bigint>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_matrix):
                part = batch.slice(at, rows_a_matrix)
                data = {n: part.column(n).to_pylist() for n in ("ids", "cu_seqlens", "id_bytes", "pack_id", "starts")}
                width = len(data["ids"][0]) // data["id_bytes"][0]
                cumulative, resets = [0], []
                for i, lengths in enumerate(data["cu_seqlens"]):
                    ends = lengths[1:] + ([width] if lengths[-1] < width else [])
                    resets += [i * width + s for s in [0, *ends[:-1]]]
                    cumulative += [i * width + e for e in ends]
                one = lambda v, t: pa.array([v], t)
                doc_ids = part.column("doc_ids")
                arrays = [
                    one(part.num_rows, pa.int32()), one(width, pa.int32()), one(data["id_bytes"][0], pa.int32()),
                    one(b"".join(data["ids"]), pa.binary()), one(cumulative, pa.list_(pa.int64())), one(resets, pa.list_(pa.int64())),
                    one(data["pack_id"], pa.list_(pa.string())), one(doc_ids.to_pylist(), pa.list_(doc_ids.type)),
                    one(data["starts"], pa.list_(pa.list_(pa.int64()))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    names = ("pack_id", "id_bytes", "ids", "cu_seqlens", "doc_ids", "starts")
    rows.select(*names).mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_matrices`` wrote; ``matrix`` makes a numpy matrix of a row."""
    return spark.read.parquet(path)


def matrix(row) -> np.ndarray:
    """The id matrix of a row of ``read_matrices``."""
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}").reshape(row["n_rows"], row["width"])


def op10_packing(spark: SparkSession, sf_dir: str, ranks_path: str = RANKS) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Vocabulary(ranks_path))
