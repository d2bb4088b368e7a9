"""Token counts by a linear longest-match automaton.

Greedy word-piece lengths without building pieces. The vocabulary is a trie with
two roots, for pieces that begin a word and for pieces that continue one. Each
node has a failure link to the node where matching goes on once its longest
pieces are taken off, and the number of pieces that are so taken off. Counting
reads each character once: it follows failure links where the trie has no child,
adding their counts, and a word is whole if it ends at the continuation root.

A word is a run of letters, digits and underscores, or a single other character
that isn't white space. A word that can't be cut into pieces is one unknown token.
The model's pieces that begin with U+2581 begin a word; the others continue one,
and single characters do both.

Defined results: null and empty texts have no words and no tokens. Repeated rows
are kept; an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import table
from cellwise.llm.sentencepiece import MODEL, NORMAL, SPACE, Model

WORD = re.compile(r"\w+|[^\w\s]")
#: Entries of a worker's cache of word lengths; a full cache is emptied.
CACHED_WORDS = 500_000


class Lengths(dict):
    """Word -> number of pieces (1 for an unknown word); the dict itself is the bounded cache."""

    def __init__(self, begin: Iterable[str], proceed: Iterable[str]):
        super().__init__()
        # Node 0 begins a word, node 1 continues one.
        self.next: list[dict[str, int]] = [{}, {}]
        whole = {0: False, 1: False}
        for root, pieces in ((0, begin), (1, proceed)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                whole[node] = bool(piece)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque((parent, c, child) for parent in (0, 1) for c, child in self.next[parent].items())
        while queue:
            parent, c, node = queue.popleft()
            if whole.get(node):
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], count
            queue.extend((node, d, child) for d, child in self.next[node].items())

    def __missing__(self, word: str) -> int:
        n = self._count(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def _count(self, word: str) -> int:
        children, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for c in word:
            while c not in children[node]:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = children[node][c]
        while node > 1:  # the end of the word takes off what is left
            total += popped[node]
            node = fail[node]
        return total if node == 1 else 1

    def __reduce__(self):  # the cache stays behind
        state = {k: getattr(self, k) for k in ("next", "fail", "popped")}
        return (_restored, (state,))


def _restored(state: dict) -> Lengths:
    found = Lengths((), ())
    found.__dict__.update(state)
    return found


def vocabulary(model: Model) -> tuple[list[str], list[str]]:
    """Pieces that begin and that continue a word."""
    pieces = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
    begin = {p.lstrip(SPACE) for p in pieces if p.startswith(SPACE)} | {p for p in pieces if len(p) == 1}
    proceed = {p for p in pieces if not p.startswith(SPACE)}
    return sorted(begin - {"", SPACE}), sorted(proceed)


def token_counts(docs: DataFrame, begin: Iterable[str], proceed: Iterable[str]) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Lengths(begin, proceed))
    rows = docs.select(F.col("doc_id"), F.col("text").alias("_whole_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1):
                found = WORD.findall(t.as_py() or "")
                words.append(len(found))
                tokens.append(sum(map(lengths.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *vocabulary(Model.load(model_path)))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words`` of ``op6_token_counts``, which SQL can express."""
    return op6_token_counts(spark, sf_dir).select("doc_id", "n_words")


WORDS_ORACLE = r"""
SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0) AS n_words FROM documents
"""
