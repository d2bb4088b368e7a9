"""SentencePiece encoding and decoding with an Aho-Corasick automaton over pieces.

The automaton reads a text once. At each position it follows the output links,
which list the pieces that end there from the longest to the shortest, and relaxes
the best way to that position:

* unigram models: the greatest sum of scores (Viterbi); of equals the longest piece.
* BPE models: the scores are merge ranks, whose sum means nothing, and Viterbi over
  them gives other ids than the model's merges do. There the way to a position is
  the one whose last two pieces stay apart when merged, which holds for exactly
  one of the pieces that end there; the result is that of the merges.

Pieces that hold white space after another character would tie words together;
without any, as is usual, a text falls into words that are encoded one by one
with the same automaton, and a bounded cache keeps the commonest words' ids.

Defined results: a null or empty text has no ids and decodes to an empty text.
Characters outside the vocabulary become byte pieces where the model has them, or
else one unknown piece for a run. U+2581 stands for a space, so a text that holds
it decodes to one with spaces. Repeated rows are kept; an empty table gives an
empty result; columns other than those named are ignored. Models with a compiled
normalisation table are refused with a ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import returning, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Entries of the caches of a worker; a full cache is emptied.
CACHED_WORDS, CACHED_PAIRS = 300_000, 400_000
#: Characters of text encoded before a batch is handed on.
BATCH_CHARS = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces and settings of a model file; small and of fixed size, so it is broadcast."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.dummy_prefix, self.squeeze = True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                for n, v in _fields(value):
                    self.kind = v if n == 3 else self.kind
                    self.byte_fallback = bool(v) if n == 35 else self.byte_fallback
                    self.unk_id = v if n == 40 else self.unk_id
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("models with a compiled normalisation table aren't supported")
                    self.dummy_prefix = bool(v) if n == 3 else self.dummy_prefix
                    self.squeeze = bool(v) if n == 4 else self.squeeze
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("encoder", "surfaces")}

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        found = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                found.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                found.append(b"")
            elif kind == UNKNOWN:
                found.append(" ⁇ ".encode())
            else:
                found.append(piece.replace(SPACE, " ").encode())
        return found

    def decode(self, ids) -> str:
        surfaces = self.surfaces
        text = b"".join([surfaces[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)


class Encoder:
    """The automaton of a model and the caches of a worker."""

    def __init__(self, model: Model):
        self.model = model
        usable = (NORMAL, USER_DEFINED)
        known = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in usable and p}
        self.rank = {p: -model.scores[i] for p, i in known.items()}
        together = {c for p in known if len(p) > 1 for c in p}
        alone = {c for c in together if c not in known}
        # Characters that only longer pieces hold can still stand alone, as unknown ones.
        self.text = [*known, *sorted(alone)]
        self.length = [len(p) for p in self.text]
        self.id = [known.get(p, -1) for p in self.text]
        self.bytes = {f"<0x{b:02X}>": b for b in range(256)}
        self.byte_ids = {b: model.pieces.index(n) for n, b in self.bytes.items()} if model.byte_fallback else {}
        scores = [model.scores[i] for i in known.values()]
        lowest = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.score = [model.scores[i] if i >= 0 else lowest for i in self.id]
        own = {p: p for p in self.text}
        self.steps = [self._steps(p, own) for p in self.text] if model.kind == BPE else []
        self.automaton = ahocorasick.Automaton()
        for t, p in enumerate(self.text):
            # A piece that its own characters don't merge into is never a result.
            if not self.steps or self.steps[t][1][-1] == p:
                self.automaton.add_word(p, t)
        if self.text:
            self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.inside = {c for c in together | {p for p in known if len(p) == 1}}
        self.units = re.compile(self._units(known, self.inside - {SPACE}))

    @staticmethod
    def _units(known: dict[str, int], inner: set[str]) -> str:
        """A pattern for the parts of a text that no piece crosses.

        Parts end before white space, and between alphanumeric and other characters
        unless a piece holds the two; characters of no piece are parts by themselves.
        """

        def chars(of: set[str]) -> str:
            return "".join(re.escape(c) for c in sorted(of))

        other = f"[^{SPACE}{chars(inner)}]+"
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known):
            return f"[{SPACE}{chars(inner)}]+|{other}"
        if not inner:
            return f"{SPACE}+|{other}"
        plain = {c for c in inner if c.isalnum()}
        marks = inner - plain
        pairs = {p[i : i + 2] for p in known for i in range(len(p) - 1)}
        tied = {x[0] for x in pairs if x[0] in plain and x[1] in marks}
        if not plain or not marks or any(x[0] in marks and x[1] in plain for x in pairs):
            return f"{SPACE}*[{chars(inner)}]+|{SPACE}+|{other}"
        w, m = f"[{chars(plain)}]", f"[{chars(marks)}]"
        bound = f"{SPACE}*(?:{w}*[{chars(tied)}]{m}+)+{w}*|" if tied else ""
        return f"{bound}{SPACE}*{w}+|{SPACE}*{m}+|{SPACE}+|{other}"

    def _steps(self, piece: str, own: dict[str, str]) -> tuple[tuple[float, ...], tuple[str, ...], tuple[str, ...]]:
        """Ranks of the merges that make a piece, in order, and the symbols at its edges before each and at the end.

        Symbols are the strings that ``own`` has for them, so that pieces share theirs.
        """
        parts, ranks, left, right = [own[c] for c in piece], [], [], []
        while True:
            left.append(parts[0])
            right.append(parts[-1])
            i, best = self._best(parts)
            ranks.append(best)
            if i < 0:
                return tuple(ranks), tuple(left), tuple(right)
            parts[i : i + 2] = [own[parts[i] + parts[i + 1]]]

    def _best(self, parts: list[str]) -> tuple[int, float]:
        """The place and rank of the next merge, the leftmost of equals; -1 and infinity if there is none."""
        rank = self.rank
        ranks = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        best = min(ranks, default=np.inf)
        return (ranks.index(best), best) if best < np.inf else (-1, np.inf)

    def _apart(self, a: int, b: int) -> bool:
        """Whether two pieces side by side stay as they are when merged."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stay(a, b)
        return found

    def _stay(self, a: int, b: int) -> bool:
        """Merges both sides in step; False if a merge across the border comes first at any point."""
        get, i, j = self.rank.get, 0, 0
        left, _, edge = self.steps[a]
        right, other, _ = self.steps[b]
        while True:
            x, y = left[i], right[j]
            across = get(edge[i] + other[j])
            if across is not None and across < x and across <= y:
                return False
            if x <= y:
                if x == np.inf:
                    return True
                i += 1
            else:
                j += 1

    def _by_ranks(self, word: str) -> list[int]:
        last = [-1] * (len(word) + 1)
        length, pairs, apart = self.length, self.pairs, self._apart
        for end, t in self.automaton.iter(word):
            if last[end + 1] < 0:
                start = end + 1 - length[t]
                if start:
                    u = last[start]
                    ok = pairs.get(u << 20 | t)
                    if not (apart(u, t) if ok is None else ok):
                        continue
                last[end + 1] = t
        return last

    def _by_scores(self, word: str) -> list[int]:
        best, last = [0.0] + [None] * len(word), [-1] * (len(word) + 1)
        length, score = self.length, self.score
        for end, t in self.automaton.iter(word):
            total = best[end + 1 - length[t]] + score[t]
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], last[end + 1] = total, t
        return last

    def _unknown(self, run: str) -> list[int]:
        if self.byte_ids:
            return [self.byte_ids[b] for b in run.encode("utf-8", "replace")]
        return [self.model.unk_id]

    def _unit(self, word: str) -> bytes:
        if word[0] not in self.inside or (SPACE in word and SPACE not in self.rank):
            return np.array(self._unknown(word), "<i4").tobytes()
        last = (self._by_ranks if self.model.kind == BPE else self._by_scores)(word)
        at, pieces = len(word), []
        while at:
            pieces.append(last[at])
            at -= self.length[last[at]]
        ids: list[int] = []
        for t in reversed(pieces):
            if self.id[t] >= 0:
                ids.append(self.id[t])
            elif self.byte_ids or not ids or ids[-1] != self.model.unk_id:
                ids.extend(self._unknown(self.text[t]))
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        get, unit = self.words.get, self._cached
        return np.frombuffer(b"".join([get(w) or unit(w) for w in self.units.findall(self.model.normalise(text))]), "<i4")

    def _cached(self, word: str) -> bytes:
        ids = self._unit(word)
        if len(word) <= 64:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids


def encode(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then ``ids`` and ``round_trip``: whether the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_whole_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                found, same = [], []
                for t in batch.column(batch.num_columns - 1):
                    value = t.as_py()
                    found.append(model.encoder.encode(value))
                    same.append(model.decode(found[-1].tolist()) == (value or ""))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = np.concatenate(found) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(same)],
                    [*keep, "ids", "round_trip"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(returning(run), f"{kinds}, ids array<int>, round_trip boolean")


def slices(batch: pa.RecordBatch, text: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about so many characters together."""
    start = size = 0
    for i, t in enumerate(batch.column(text)):
        n = len(t.as_buffer()) if t.is_valid else 0
        if size and size + n > chars:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(rows: DataFrame, model: Model, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then ``text`` from the ids; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    chosen = rows.select(*[F.col(c) for c in keep], F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x.as_py() or []) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(returning(run), f"{kinds}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), Model.load(model_path))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
