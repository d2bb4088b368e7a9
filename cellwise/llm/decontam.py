"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are compared as lower-case words without punctuation around them; in scripts
that don't part words by spaces each character is a word. An item
leaks into a document if some stretch of the document's words is within
``floor(MAX_EDITS * words of the item)`` word edits (insert, delete, replace) of it.

* Embedding: the CGK walk copies word i to output place j and moves to i + 1 if a
  random bit of (j, word) is set. Two walks over the same words take the same way,
  whatever precedes or follows them.
* LSH: a key is the first places of a walk. Windows start at every word of an item
  and of a document. ``m`` words with ``k`` edits always keep ``ceil((m - k) / (k + 1))``
  words in a row without an edit, and a window that starts there shares each key
  that reads no further. So windows are as long as that run, not as the item: with
  up to a fifth of the words edited, walks as long as the item would seldom agree.
* The number of walks follows from TARGET_RECALL at the worst placement of the
  edits; other placements keep longer runs, which have more windows.
* A key that reads fewer than ``need`` words is void. All others read the first
  ``need`` words one after another, so windows at which these occur in no item
  are passed over before the walk without losing a shared key.
* Verification: each candidate (document, item, alignment) is checked exactly by
  bit-parallel approximate matching over a stretch that holds every alignment
  within the limit of edits.

The benchmark is taken in blocks of BLOCK_WORDS words at most; a block is collected
and broadcast, one at a time, so its size is bounded whatever the benchmark's is, and
documents are read once a block. Nothing else of the documents leaves the executors but the
matches. Recall is measured against brute force in the tests.

Defined results: null and empty texts or items match nothing. Items of fewer than
five words allow no edit and match where their words occur in a row. Items with equal
texts are all reported. Repeated documents are reported each. Empty tables give an
empty result. Columns other than ``doc_id``, ``text`` and ``item_id`` are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.llm.common import discard, materialize, returning, table, text_key, without

MAX_EDITS = 0.2
BLOCK_WORDS = 200_000
#: Tables of matches that are joined into one.
JOINED = 16
SEED = 20240101


#: Share of copies to be found of those whose edits are placed worst.
TARGET_RECALL = 0.9999
#: A run of more words isn't asked for, and no more than NEED words of a key.
LONGEST_RUN, NEED = 4, 3


class Spec(NamedTuple):
    """How items are looked for of which a copy keeps ``run`` words in a row."""

    run: int
    need: int  # words that a key reads at least
    width: int  # output places of a walk, all of them read by its key
    walks: int


def run_of(words: int) -> int:
    """Words in a row that any copy of an item of so many words keeps, up to LONGEST_RUN."""
    edits = int(MAX_EDITS * words)
    return min(-(-(words - edits) // (edits + 1)), LONGEST_RUN)


def spec_of(run: int, target: float = TARGET_RECALL) -> Spec:
    """The width with the likeliest keys within a run, and as many walks as the target recall takes."""
    need = min(run, NEED)

    def share(width: int) -> float:  # of walks that read ``need`` to ``run`` words
        return sum(comb(width - 1, moves) for moves in range(need - 1, run)) / 2 ** (width - 1)

    width = max(range(need, 2 * run + 1), key=share)
    hit = share(width)
    return Spec(run, need, width, 1 if hit == 1 else ceil(log(1 - target) / log(1 - hit)))


TABLE_BITS = 22
#: Keys are odd numbers but for this one.
VOID = 0
#: Words of no item between documents that are searched together, and how many words are.
GAP, GROUP_WORDS = 24, 200_000
#: Candidates listed at a time.
LISTED = 1 << 20
#: Han, kana, Thai, Lao, Myanmar and Khmer, which don't part words by spaces.
UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17e0-\u17e9"
    "\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff"
)
_WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}](?:[^\s{UNSPACED}]*[^\W_{UNSPACED}])?")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation around them; words of punctuation only are left out."""
    return _WORD.findall((text or "").lower())


class Index:
    """Keys of the windows of the items that keep a run of one length."""

    def __init__(self, items: dict[int, np.ndarray], vocabulary: int, spec: Spec, seed: int = SEED):
        self.spec, self.numbers = spec, list(items)
        words = list(items.values())
        random = np.random.default_rng([seed, spec.run])
        self.bits = random.integers(0, 1 << 63, (spec.walks, vocabulary + 1), dtype=np.int64)
        self.mix = random.integers(1, 1 << 62, (spec.walks, spec.width), dtype=np.int64) | 1
        self.begun = np.zeros(1 << TABLE_BITS, bool)
        for w in words:
            self.begun[self._beginnings(w)[: len(w) - spec.need + 1]] = True
        keys, entries = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int32)]
        for n, w in enumerate(words):
            found = self.keys(w, np.arange(len(w)))
            keys.append(found.ravel())
            starts = np.broadcast_to(np.arange(len(w)), found.shape).ravel()
            entries.append(np.stack([np.full(found.size, n), starts], 1).astype(np.int32))
        key, entry = np.concatenate(keys), np.concatenate(entries)
        order = np.argsort(key, kind="stable")
        order = order[key[order] != VOID]
        self.key, self.entry = key[order], entry[order]
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.key & ((1 << TABLE_BITS) - 1)] = True

    def _beginnings(self, words: np.ndarray) -> np.ndarray:
        """A slot of ``begun`` for the first ``need`` words of each window."""
        padded = np.concatenate([words, np.zeros(self.spec.need, np.int32)]).astype(np.int64)
        total = np.zeros(len(words), np.int64)
        for j in range(self.spec.need):
            total = (total + padded[j : j + len(words)]) * np.int64(-7046029254386353131)
            total ^= total >> 32 & 0xFFFFFFFF
        return total & ((1 << TABLE_BITS) - 1)

    def _starts(self, words: np.ndarray) -> np.ndarray:
        """Places of documents at which a window may share a key with an item."""
        return np.flatnonzero((words > 0) & self.begun[self._beginnings(words)])

    def keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of keys of the windows at ``starts`` for each walk.

        A walk that reads a word of no item, a place behind the end or too few words has the key VOID.
        """
        spec = self.spec
        padded = np.concatenate([words, np.zeros(spec.width + 1, np.int32)])
        out = np.empty((spec.walks, len(starts)), np.int64)
        for walk in range(spec.walks):
            at = starts.copy()
            total = np.zeros(len(starts), np.int64)
            void = np.zeros(len(starts), bool)
            bits = self.bits[walk]
            for j in range(spec.width):
                if j:
                    at += bits[word] >> (3 * j) & 1
                word = padded[at]
                total += word * self.mix[walk, j]
                void |= word == 0
            void |= at - starts + 1 < spec.need
            out[walk] = ((total ^ (total >> 29)) * np.int64(-7046029254386353131) ^ walk) | 1
            out[walk][void] = VOID
        return out

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``document, item, place``: items that may begin near these places.

        ``words`` holds documents one after another, parted by ``GAP`` words of no
        item; ``offsets`` are their beginnings.
        """
        starts = self._starts(words)
        for at in range(0, len(starts), 1 << 16):
            part = starts[at : at + (1 << 16)]
            keys = self.keys(words, part)
            rows, columns = np.nonzero(self.seen[keys & ((1 << TABLE_BITS) - 1)])
            key = keys[rows, columns]
            lows, highs = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            sums = np.cumsum(highs - lows)
            done = 0
            while done < len(key):
                before = sums[done - 1] if done else 0
                end = max(done + 1, int(np.searchsorted(sums, before + LISTED, "right")))
                low, n, window = lows[done:end], (highs - lows)[done:end], part[columns[done:end]]
                done = end
                entry = self.entry[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                window = np.repeat(window, n)
                doc = np.searchsorted(offsets, window, "right") - 1
                found = np.stack([doc, entry[:, 0], window - entry[:, 1] - offsets[doc]], 1)
                for d, item, place in np.unique(found, axis=0).tolist():
                    yield d, self.numbers[item], place


class Matcher:
    """The indexes of one block of items and exact verification; its size follows BLOCK_WORDS."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        known = [(i, words_of(t)) for i, t in items]
        known = [(i, w) for i, w in known if w]
        vocabulary = sorted({w for _, words in known for w in words})
        self.ids = {w: n + 1 for n, w in enumerate(vocabulary)}  # 0: a word of no item
        self.numbers = [i for i, _ in known]
        self.words = [np.array([self.ids[w] for w in words], np.int32) for _, words in known]
        self.limit = [int(MAX_EDITS * len(w)) for w in self.words]
        self.indexes = []
        for run in sorted({run_of(len(w)) for w in self.words}):
            own = {n: w for n, w in enumerate(self.words) if run_of(len(w)) == run}
            self.indexes.append(Index(own, len(vocabulary), spec_of(run), seed))
        self.masks = []
        for words in self.words:
            mask: dict[int, int] = {}
            for j, w in enumerate(words.tolist()):
                mask[w] = mask.get(w, 0) | 1 << j
            self.masks.append(mask)

    def verify(self, words: list[int], item: int, begin: int, end: int) -> int:
        """The least number of edits between an item and any stretch of ``words[begin:end]``."""
        mask, m = self.masks[item], len(self.words[item])
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        least = score
        for w in words[begin:end]:
            eq = mask.get(w, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(d | up)), up & d
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | (full & ~(x | plus)), plus & x
            least = min(least, score)
        return least

    def matches(self, texts: Iterable[str | None]) -> Iterator[dict[int, int]]:
        """For each text, item number -> least edits of the items that leak into it."""
        group: list[list[int]] = []
        size = 0
        for text in texts:
            group.append(list(map(self.ids.get, words_of(text), repeat(0))))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self._matches(group)
                group, size = [], 0
        yield from self._matches(group)

    def _matches(self, group: list[list[int]]) -> Iterator[dict[int, int]]:
        offsets = np.cumsum([0, *(len(g) + GAP for g in group)])
        words = np.zeros(offsets[-1], np.int32)
        for at, g in zip(offsets, group, strict=False):
            words[at : at + len(g)] = g
        spans: list[dict[int, list[tuple[int, int]]]] = [{} for _ in group]
        places = {c for index in self.indexes for c in index.candidates(words, offsets[:-1])}
        for doc, item, begin in sorted(places):
            k = self.limit[item]
            # The alignment tells the start up to the edits before the window, so twice the limit is wide enough.
            a, b = max(0, begin - 2 * k), min(len(group[doc]), begin + len(self.words[item]) + 2 * k)
            own = spans[doc].setdefault(item, [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        for listed, by_item in zip(group, spans, strict=True):
            least = {i: min(self.verify(listed, i, a, b) for a, b in own) for i, own in by_item.items()}
            yield {i: n for i, n in least.items() if n <= self.limit[i]}


@dataclass
class Blocks:
    """Items dealt into blocks of bounded size."""

    items: DataFrame
    count: int

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        for b in range(self.count):
            rows = self.items.filter(F.col("block") == b).select("n", "text").collect()
            yield sorted((r["n"], r["text"]) for r in rows)


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[Blocks, DataFrame]:
    """Blocks of distinct item texts, and ``n, item_id`` for every item."""
    rows = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    unspaced = F.length(F.regexp_replace("text", f"[^{UNSPACED}]+", ""))
    texts = rows.select("text").distinct().withColumn("size", F.size(F.split("text", r"\s+")) + unspaced)
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("n"), "text", "size"), "items")
    total = texts.agg(F.sum("size")).first()[0]
    # Dealt in lanes that are filled side by side; one item alone may be longer than a block.
    lanes = min(max((total or 0) // block_words, 1), 64)
    order = Window.partitionBy(F.col("n") % lanes).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    dealt = materialize(texts.withColumn("block", F.floor(before / max(1, block_words // lanes))), "blocks")
    count = (dealt.agg(F.max("block")).first()[0] or 0) + 1 if total else 0
    ids = rows.join(dealt.select("n", "text"), "text").select("n", "item_id")
    return Blocks(dealt, int(count)), ids


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The columns ``keep`` of each leaking row of ``docs``, then ``item_id`` and ``edits``.

    Blocks are searched one after another, when this is called: one block's broadcast
    lives at a time, and its matches are written before the next one's is made.
    """
    spark = docs.sparkSession
    blocks, ids = blocks_of(benchmark, block_words)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_whole_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n bigint, edits int"
    parts: list[DataFrame] = []
    for items in blocks:
        shared = spark.sparkContext.broadcast(Matcher(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                row, item, edits = [], [], []
                texts = (t.as_py() for t in batch.column(batch.num_columns - 1))
                for i, leaks in enumerate(index.matches(texts)):
                    for n, least in leaks.items():
                        row.append(i)
                        item.append(index.numbers[n])
                        edits.append(least)
                taken = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(item, pa.int64()), pa.array(edits, pa.int32())], [*keep, "n", "edits"]
                )

        part = materialize(rows.mapInArrow(returning(run), schema), "leaks")
        shared.unpersist(blocking=True)
        parts.append(part)
        if len(parts) == JOINED:  # so that the plan doesn't grow with the benchmark
            whole = materialize(reduce(DataFrame.unionByName, parts), "leaks")
            for one in parts:
                discard(one)
            parts = [whole]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.join(ids, "n").select(*keep, "item_id", "edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    keyed = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("_row_key"), F.col("text"))
    gone = find_leaks(keyed, benchmark, ("doc_id", "_row_key")).select(F.col("doc_id").alias("_id"), F.col("_row_key").alias("_key"))
    return without(docs, gone.distinct().withColumn("_stays", F.lit(False)), text_key(F.col("text")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, edits``: a row for each document and item that leaks into it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
