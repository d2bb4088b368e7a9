"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base entities (e-mail addresses, IP addresses, card and phone numbers) are found
by pattern and check sum. They, and strings that look like keys (long, of letters and
digits mixed), seed a bootstrap: every token that holds a digit or an at sign, or run
of such tokens without letters, is a possible identifier. The word before it, the two
words before it and the word behind it are its contexts. A context with the exact
shape of the value, and the same with its form only (at sign, digits without letters or
mixed, and the length by powers of two), make its lexical patterns, so a sure context
also discovers shapes that no seed has. Occurrences of both form a bipartite graph of
patterns and instances. A round scores patterns by the instances they surround
and then instances by their patterns:

    confidence(p, kind) = specificity(p) * sum of score(i, kind) / (instances + 1)
    score(i, kind)      = 1 - product over p of (1 - confidence(p, kind))
    seeds: 1, strings that look like keys: KEY_SCORE

``specificity`` is the share of a context's occurrences in the whole corpus that stand
beside a possible identifier, so words of the language score near 0; contexts below
MIN_WEIGHT, and those with fewer than MIN_SUPPORT instances, stay out of the graph. Instances are distinct values: copies of a document
lend no support. Instances that score in one round support other patterns in the next,
so the bootstrap spreads from its seeds. After ROUNDS, patterns with MIN_CONFIDENCE and
instances that score MIN_SUPPORT together give what stands beside them: identifiers
that no base pattern matches, under the kind that the pattern is surest of. A string that
looks like a key is given only beside such a pattern, under the kind ``secret``.

Positions come from the text's parts between matches; ``split`` and
``regexp_extract_all`` walk the same matches, and offsets are prefix sums by
growing strides, so a text with n matches takes n log n steps. The patterns are written with
possessive loops and start only where a run starts (or at the end of the last
match), which gives the same leftmost matches in linear time.

Defined results: null and empty texts have no spans. Null or repeated ``doc_id``
are kept as they are, a row for a row. A corpus without seeds discovers nothing.
An empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are ignored, whatever their names. Context words are looked for within REACH
characters of an identifier; a longer word has its end there (its beginning, behind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import bounded, let, materialize, table

# The base patterns by kind, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A token that holds a digit or an at sign, or one to six such tokens in a row that hold no letter.
_NUMBER = r"(?=[^\s0-9]*+[0-9])[^\s\p{L}@]++(?!\S)"
FILLER = rf"(?<!\S)(?:{_NUMBER}(?:\x20{_NUMBER}){{0,5}}+|(?=[^\s0-9@]*+[0-9@])\S++)"
#: What looks like a key: letters and digits mixed, four of each at least.
KEY = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_=-]{24,512}$"
LEAD, TRAIL = r"^[\"'<\[{]+", r"[.,;:!?\"'>\]}#$%&*]+$"
#: Kinds that the bootstrap adds to those of the base.
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
REACH = 200
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_WEIGHT, KEY_SCORE = 3, 2.39, 0.5, 0.2, 0.8
#: A text has fewer matches than sixteen to this power, as it holds at most two gigabytes.
STRIDES = 8


def _scan(values: str, total, zero: str) -> str:
    """SQL for the running totals of an array, by strides that grow sixteenfold; ``total`` joins terms."""
    for k in range(STRIDES):
        terms = ["x", *(f"coalesce(get(a, i - {m * 16**k}), {zero})" for m in range(1, 16))]
        values = f"get(transform(array({values}), a -> if(size(a) > {16**k}, transform(a, (x, i) -> {total(terms)}), a)), 0)"
    return values


def _sum(terms: list[str]) -> str:
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})" if half else terms[0]


def _greatest(terms: list[str]) -> str:
    return f"greatest({', '.join(terms)})"


#: SQL for ``start, end, value, before, after`` of each of the matches ``f`` that lie between the parts ``g``.
_STARTS = _scan("transform(f, (v, i) -> length(get(g, i)) + if(i > 0, length(get(f, i - 1)), 0))", _sum, "0")
_MATCHES = f"""get(transform(array({_STARTS}), s -> transform(f, (v, i) -> named_struct(
    'start', get(s, i), 'end', get(s, i) + length(v), 'value', v,
    'before', right(get(g, i), {REACH}), 'after', left(get(g, i + 1), {REACH})))), 0)"""


def _placed(text: str, pattern: str) -> Column:
    """``start, end, value, before, after`` of each match in a column; offsets in code points."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"""get(transform(array(regexp_extract_all({text}, '{quoted}', 0)), f -> if(size(f) > 0,
        get(transform(array(split({text}, '{quoted}', -1)), g -> {_MATCHES}), 0), null)), 0)"""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    return F.expr(f"coalesce({found}, cast(array() as {kind}))")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.length(digits).between(12, 19) & (
        F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _base(name: str, kind: str) -> Column:
    """The valid matches of a kind in a column as structs ``start, k, end``."""
    text = F.col(name)
    present = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    found = F.filter(_placed(name, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("end"))
    )
    return F.when(present, spans).otherwise(empty)


def _form(value: Column) -> Column:
    """What is left of a shape: its class of characters and of length. It begins with a space, as no shape does."""
    kind = F.when(value.contains("@"), "at").when(value.rlike(r"\p{L}"), "mixed").otherwise("digits")
    return F.concat(F.lit(" "), kind, F.floor(F.log2(F.greatest(F.length(value), F.lit(1)))).cast("string"))


#: SQL for the kind of a base span that overlaps each of the matches ``m``, or null: at the end of a match,
#: the farthest end of the base spans ``b`` that begin before it.
_N = len(ALL_KINDS)
_FAR = _scan("transform(e, x -> x.mark)", _greatest, "-1L")
_OVERLAPPING = f"""get(transform(array(array_sort(concat(
    transform(m, x -> named_struct('at', x.end, 'base', 0, 'start', x.start, 'mark', -1L)),
    transform(b, x -> named_struct('at', x.start, 'base', 1, 'start', x.start, 'mark', x.end * {_N}L + x.k))))), e ->
  get(transform(array({_FAR}), far ->
    transform(filter(transform(e, (x, i) -> named_struct('base', x.base, 'start', x.start, 'far', get(far, i))), x -> x.base = 0),
      x -> if(x.far >= (x.start + 1L) * {_N}, cast(x.far % {_N} as int), null))), 0)), 0)"""


def base_rows(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, fillers`` for each row of ``docs``; written once.

    ``base`` holds the base spans by start and kind; ``fillers`` the possible
    identifiers with their contexts and, for seeds, the kind of their base span.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text)
    spans = F.array_sort(F.concat(*[_base("_text", k) for k in KINDS]))

    def filler(m: Column, k: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(m["value"], LEAD, ""), TRAIL, "")
        start = m["start"] + F.length(m["value"]) - F.length(F.regexp_replace(m["value"], LEAD, ""))
        before, after = F.lower(m["before"]), F.lower(m["after"])
        two = F.concat_ws(" ", *[F.regexp_extract(before, r"(\S+)\s+(\S+)\s*$", i) for i in (1, 2)])
        shape = F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]+", "9")
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.lower(value).alias("value"),
            k.alias("k"),
            (k.isNull() & value.rlike(KEY)).alias("key"),
            F.array(
                F.struct(F.lit("L").alias("side"), F.regexp_extract(before, r"(\S+)\s*$", 1).alias("word")),
                F.struct(F.lit("LL").alias("side"), F.when(two != " ", two).otherwise("").alias("word")),
                F.struct(F.lit("R").alias("side"), F.regexp_extract(after, r"^\s*(\S+)", 1).alias("word")),
            ).alias("contexts"),
            F.array(shape, _form(value)).alias("shapes"),
        )

    found = rows.select("row", "doc_id", "_text", spans.alias("b"))
    found = found.select("row", "doc_id", "b", F.when(F.col("_text").rlike("[0-9@]"), _placed("_text", FILLER)).alias("m"))
    kinds = F.expr(f"if(size(b) > 0, {_OVERLAPPING}, cast(array() as array<int>))").alias("ks")
    fillers = let(F.col("ks"), lambda ks: F.transform("m", lambda x, i: filler(x, F.get(ks, i))))
    fillers = F.filter(fillers, lambda f: f["end"] > f["start"])
    return materialize(
        found.select("row", "doc_id", "b", "m", kinds).select("row", "doc_id", F.col("b").alias("base"), fillers.alias("fillers")), "pii"
    )


def _context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``word, all``: how often each context of ``contexts(word)``, one word or two, occurs in the whole corpus."""
    words = docs.select(F.split(F.lower(F.col("text")), r"\s+").alias("words"))
    single = contexts.filter("NOT contains(word, ' ')")
    double = contexts.filter("contains(word, ' ')").select("word", F.split("word", " ")[1].alias("one"))
    small = bounded(contexts) is not contexts
    near = F.broadcast if small else lambda d: d
    # Counting comes before the join where that is a shuffle.
    each = words.select(F.explode("words").alias("word"))
    each = each.join(near(single), "word", "left_semi") if small else each
    ones = each.groupBy("word").agg(F.count(F.lit(1)).alias("all"))
    if double.isEmpty():
        return ones.join(near(single), "word", "left_semi")
    # Of two words the second is looked up first, so few pairs are made.
    pairs = words.select("words", F.posexplode("words").alias("at", "one")).filter("at > 0")
    pairs = pairs.join(near(double.select("one").distinct()), "one", "left_semi") if small else pairs
    pairs = pairs.select(F.concat(F.get("words", F.col("at") - 1), F.lit(" "), "one").alias("word"))
    twos = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("all"))
    return ones.unionByName(twos).join(near(contexts), "word", "left_semi")


def discover(
    docs: DataFrame,
    rows: DataFrame,
    rounds: int = ROUNDS,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_weight: float = MIN_WEIGHT,
) -> DataFrame | None:
    """``row, start, k, end`` of identifiers that patterns discover; None without a pattern to score."""
    places = rows.select("row", F.explode("fillers").alias("f")).select("row", "f.*")
    if places.filter("k IS NOT NULL OR key").isEmpty():
        return None
    columns = ["row", "start", "end", "value", "k", "key", "shapes"]
    beside = places.select(*columns, F.explode("contexts").alias("c")).select(*columns, "c.side", "c.word")
    beside = materialize(beside.filter("word <> ''"), "places")
    # A pattern needs MIN_SUPPORT of instances that score 1 at most.
    held = beside.groupBy("side", "word", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("side", "word")
    held = held.agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("values")).filter(F.col("values") >= min_support)
    held = materialize(held, "contexts")
    counted = _context_counts(docs, held.select("word").distinct())
    weight = held.join(counted, "word").select(
        "side", "word", F.least(F.lit(1.0), F.col("held") / F.greatest("all", F.lit(1))).alias("weight")
    )
    # No pattern's confidence exceeds its weight.
    weight = bounded(materialize(weight.filter(F.col("weight") >= min_weight), "weights"))
    shaped = beside.join(weight, ["side", "word"]).withColumn("shape", F.explode("shapes")).drop("shapes")
    shaped = materialize(shaped, "shaped")
    pattern = ["side", "word", "shape"]

    values = materialize(shaped.groupBy("value").agg(F.min("k").alias("k"), F.max("key").alias("key")), "values")
    graph = shaped.groupBy(*pattern, "value").agg(F.first("weight").alias("weight")).join(values, "value")
    graph = materialize(graph, "graph")
    base = values.filter("k IS NOT NULL").select("value", F.col("k").alias("kind"), F.lit(1.0).alias("score"))
    keys = values.filter("k IS NULL AND key").select("value", F.lit(SECRET).alias("kind"), F.lit(KEY_SCORE).alias("score"))
    seeds = base.unionByName(keys)
    if seeds.isEmpty():
        return None
    totals = graph.groupBy(*pattern).agg(F.count(F.lit(1)).alias("instances"), F.first("weight").alias("weight"))
    scored = seeds
    confidence = None
    for _ in range(rounds):
        sums = graph.select("value", *pattern).join(scored, "value").groupBy(*pattern, "kind").agg(F.sum("score").alias("mass"))
        confidence = sums.join(totals, pattern).select(
            *pattern, "kind", "mass", (F.col("weight") * F.col("mass") / (F.col("instances") + 1)).alias("confidence")
        )
        confidence = materialize(confidence, "confidence")
        # All kinds of unseen instances score anew, and other kinds of what looks like a key.
        near = graph.filter("k IS NULL").drop("weight").join(bounded(confidence), pattern).filter(f"NOT (key AND kind = {SECRET})")
        rest = F.sum(F.ln(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
        scored = seeds.unionByName(near.groupBy("value", "kind").agg((1 - F.exp(rest)).alias("score")))
    sure = confidence.filter((F.col("confidence") >= min_confidence) & (F.col("mass") >= min_support))
    best = (
        shaped.filter("k IS NULL")
        .join(bounded(sure.select(*pattern, "kind", "confidence")), pattern)
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("b"))
    )
    return best.select("row", "start", (-F.col("b.order")).alias("k"), "end")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def find_pii(docs: DataFrame, **bootstrap) -> DataFrame:
    """``doc_id, base, added`` per row: base spans and discovered ones, each ``start, k, end``; ``k`` numbers ALL_KINDS."""
    rows = base_rows(docs)
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    found = discover(docs, rows, **bootstrap)
    if found is None:
        return rows.select("doc_id", "base", none.alias("added"))
    per_row = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end"))).alias("added"))
    per_row = bounded(materialize(per_row, "added"))
    return rows.join(per_row, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _base_columns() -> list[Column]:
    number = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    digest = F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return ["doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], digest]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans; ``n_added`` of the ``n_spans`` were discovered."""
    return find_pii(table(spark, sf_dir, "documents")).select(
        *_base_columns(),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op3_pii``, which SQL can express."""
    return base_rows(table(spark, sf_dir, "documents")).select(*_base_columns())


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    return f"""
  SELECT doc_id, r, {KINDS.index(kind)} AS k, pos AS s, pos + length(v) AS e FROM (
    SELECT doc_id, r, unnest(vs) AS v, unnest([list_sum(list_transform(gs[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0) FOR i IN range(1, len(vs) + 1)]) AS pos
    FROM (SELECT doc_id, r, regexp_extract_all(t, '{pattern}') AS vs, string_split_regex(t, '{pattern}') AS gs FROM d)
    WHERE len(vs) > 0
  ) WHERE {valid}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN c ELSE 2 * c - CASE WHEN c > 4 THEN 9 ELSE 0 END END "
    f"FOR c, i IN list_transform(string_split(reverse({_DIGITS}), ''), lambda x: x::INT)]) % 10 = 0"
)
BASE_ORACLE = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join((
        _sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda x: x::HUGEINT)) <= 255"),
        _sql_spans("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _sql_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ))
    + """), listed AS (
  SELECT r, string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS l,
         count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip,
         count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(l, '')) AS base_sha256
FROM d LEFT JOIN listed USING (r)
"""
)
