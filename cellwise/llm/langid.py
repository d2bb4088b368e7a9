"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed character n-grams of the whole text (one to three lower-case
letters, words bounded by spaces), as square roots of their shares, normalised.
One-versus-one linear SVMs decide among families; within the family that wins,
one-versus-one linear SVMs separate its languages by votes and margins.

The training sample is bounded and documented: at most PER_LANGUAGE rows of each
language and MOST_ROWS of all, those with the least hash of ``doc_id`` and text, of the
MOST_LANGUAGES languages with most rows; everything else (features, prediction)
covers every row and whole texts. The models have a bounded size: at most
MOST_LANGUAGES^2 / 2 vectors of DIM weights.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
and for every text where there is nothing to learn from. Rows without a language
are predicted, not learnt from. With one language it is always predicted. Codes
outside the table of families are families of their own. Repeated rows are kept.
An empty table gives an empty result. Columns other than ``doc_id``, ``text`` and
(to learn from) ``lang`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cellwise.llm.common import packed, returning, table
from cellwise.sources.shared import small_table

# Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "ur"),
}
DIM = 2048
PER_LANGUAGE = 500
#: Rows of the training sample altogether, which bounds what comes to the driver.
MOST_ROWS = 20_000
#: Languages that are learnt, those with most rows.
MOST_LANGUAGES = 100
UNKNOWN = "und"
#: Code points hashed at a time, so that a text of any length needs bounded memory.
SLICE = 1 << 20

#: What makes a letter, here and in the JVM: the Unicode categories Lu, Ll, Lt, Lm and Lo.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """The feature vector of a whole text, or None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    counts = np.zeros(dim)
    for at in range(0, len(text), SLICE):
        # Two more characters, so that the n-grams across slices count as well.
        points = np.frombuffer(text[at : at + SLICE + 2].lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.where((points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 170)), 32, points)
        points = np.concatenate(([32], points, [32])).astype(np.uint32)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        c = points[keep]
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for hashes in (one[c != 32], two, three):
            counts += np.bincount((hashes >> np.uint32(15)) % np.uint32(dim), minlength=dim)
    root = np.sqrt(counts)
    return (root / max(np.linalg.norm(root), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge) by accelerated gradient descent; y is -1 or 1.

    Classes weigh alike. Starts from zero and has no random part.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    rate = 1 / (2 * 2.0 + penalty)  # rows have a squared norm of 2
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = penalty * v - 2 * x.T @ (share * y * slack)
        new = (v - rate * step).astype(x.dtype)
        v, w = new + x.dtype.type(k / (k + 3)) * (new - w), new
    return w.astype(np.float32)


@dataclass
class Model:
    """Pairwise models: among families, and by family among its languages."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    among: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    within: dict[str, dict[tuple[int, int], np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.families:
            return UNKNOWN, 0.0
        i, sure = _vote(x, len(self.families), self.among)
        langs = self.members[self.families[i]]
        j, surer = _vote(x, len(langs), self.within[self.families[i]])
        return langs[j], sure * surer


def _pairs(x: np.ndarray, y: np.ndarray, n: int) -> dict[tuple[int, int], np.ndarray]:
    found = {}
    for i, j in combinations(range(n), 2):
        rows = (y == i) | (y == j)
        found[i, j] = fit_svm(x[rows], np.where(y[rows] == i, 1.0, -1.0))
    return found


def _vote(x: np.ndarray, n: int, models: dict[tuple[int, int], np.ndarray]) -> tuple[int, float]:
    """The class with most votes (of equals, the larger sum of margins), and its least pairwise probability."""
    votes, margins, least = np.zeros(n), np.zeros(n), np.ones(n)
    for (i, j), w in models.items():
        m = float(x @ w[:-1] + w[-1])
        votes[i if m >= 0 else j] += 1
        margins[i] += m
        margins[j] -= m
        p = 1 / (1 + np.exp(-np.clip(4 * m, -60, 60)))
        least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
    best = max(range(n), key=lambda k: (votes[k], margins[k], -k))
    return best, float(least[best])


def fit(x: np.ndarray, langs: list[str]) -> Model:
    if not langs:
        return Model()
    names = sorted({family(v) for v in langs})
    model = Model(names, {f: sorted({v for v in langs if family(v) == f}) for f in names})
    of = np.array([names.index(family(v)) for v in langs])
    model.among = _pairs(x, of, len(names))
    all_langs = np.array(langs)
    for i, name in enumerate(names):
        rows = of == i
        own = np.array([model.members[name].index(v) for v in all_langs[rows]])
        model.within[name] = _pairs(x[rows], own, len(model.members[name]))
    return model


def training_rows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` rows of each language, those with the least hash.

    The share to take is read from the counts by language first, so only about
    twice the sample is ever ranked.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    rank = F.xxhash64("doc_id", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = rank.bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    few = _few(counts)
    per_language = min(per_language, max(1, MOST_ROWS // max(1, few.count())))
    likely = rows.join(F.broadcast(few), "lang").filter(part * F.col("n") <= 2.0 * per_language + 50)
    order = Window.partitionBy("lang").orderBy(part, rank, "doc_id")
    return likely.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language).drop("_rank", "n")


def _few(counts: DataFrame, most: int = MOST_LANGUAGES) -> DataFrame:
    """The counts of the languages with most rows, as a local table that starts no Python workers."""
    found = counts.orderBy(F.desc("n"), "lang").take(most)
    return small_table(counts.sparkSession, found, "lang string, n bigint")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> Model:
    """Fit on a bounded sample of ``doc_id, text, lang``; features are made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t.as_py(), dim) for t in batch.column(1)]
            data = [None if v is None else v.astype("<f4").tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["k", "lang", "x"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    sample = training_rows(labelled, per_language).select("doc_id", "text", "lang")
    rows = sample.mapInArrow(returning(run), f"k {kind}, lang string, x binary").filter("x IS NOT NULL").collect()
    rows.sort(key=lambda r: (r["lang"], str(r["k"]), bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows]).reshape(len(rows), dim)
    return fit(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, dim: int = DIM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, then ``lang_pred`` and ``score``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text").alias("_whole_text"))
    return _predicted(rows, model, lambda b: b.column(1), dim).select("_row.*", "lang_pred", "score")


def _predicted(rows: DataFrame, model: Model, texts, dim: int = DIM) -> DataFrame:
    """``_row, lang_pred, score`` from rows that begin with ``_row``; ``texts`` finds the texts in a batch."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size is bounded by MOST_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(features(t.as_py(), dim)) for t in texts(batch)]
            labels, scores = pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), labels, scores], ["_row", "lang_pred", "score"])

    kinds = StructType([rows.schema["_row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(returning(run), kinds)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out and predict every row."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, in ``lang`` the language that is predicted.

    All other columns are as they were. Where there is nothing to learn from, all rows with a letter
    stay and keep their ``lang``. One pass; nothing is shuffled but the training sample.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    learnt = bool(model.families)
    if not learnt:
        model = Model(["any"], {"any": ["any"]}, {}, {"any": {}})
    place = docs.columns.index("text")
    found = _predicted(packed(docs), model, lambda b: b.column(0).field(place)).filter(F.col("lang_pred") != UNKNOWN)
    of = {c: F.col("_row").getField(c).alias(c) for c in docs.columns}
    if learnt:
        of["lang"] = F.col("lang_pred").alias("lang")
    return found.select(*of.values())


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, has_letter`` of ``op1_langid``, which SQL can express."""
    docs = table(spark, sf_dir, "documents")
    letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letter)


#: The check sum bit by bit: a byte is joined, then eight times the state is halved.
HELD_OUT_ORACLE = r"""
SELECT doc_id, coalesce(regexp_matches(text, '\p{L}'), false) AS has_letter,
       coalesce(xor(list_reduce(
         flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT
       ), 4294967295::BIGINT) % 4 = 2, false) AS held_out
FROM documents
"""
