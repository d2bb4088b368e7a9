"""WARC round trip, decontamination and the pipeline."""

import hashlib
import random

import pytest

import corpus_pipeline
from cellwise.llm import decontam, registry, sentencepiece, simhash, warc
from cellwise.llm.common import new_path
from tests.llm.conftest import docs_of

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_round_trip(spark, small_splits):
    """Payloads that hold whole records, magics and line ends; files cut into many splits."""
    htmls = ["a" * 100, None, "", "x" * 1500, "x" * 1500, "é" * 700, "pre " + FAKE + "post" + FAKE * 2, "WARC/1.0\r\n" * 3,
             "y" * 9000 + FAKE + "z" * 9000, "WWARC/1.0\r\n\r\n\r\n"]
    rows = [(i, f"http://x/{i}", h, 0) for i, h in enumerate(htmls * 2)] + [(None, None, "nul", 1), (3, "dup\n", "x" * 1500, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    last = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, -1), i)
    expected = []
    for i, _, h, _ in rows:
        again = i is not None and i < last.get(h, -1)
        data = (h or "").encode()
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    found = warc.round_trip(pages.coalesce(2), new_path(spark, "test"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, found.collect())) == sorted(map(key, expected))
    assert warc.round_trip(pages.limit(0), new_path(spark, "test")).count() == 0


def test_odd_urls_and_repeated_ids(spark):
    """Line ends of Unicode in a url begin no header field; a revisit is found by id and digest."""
    odd = "http://x/\x85Content-Length: 5\u2028Content-Length: 5\rContent-Length: 5\r\n\r\nWARC/1.0\r\n ü🙂"
    a, b = "a" * 1200, "b" * 1300
    rows = [(1, odd, "first"), (2, odd, a), (7, "u", a), (7, "v", b), (3, "w", b), (4, None, "x" * 2000), (5, "y", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = new_path(spark, "test")
    found = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, path).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert found == {(1, 5, sha("first"), "response", None), (2, 1200, sha(a), "revisit", 7), (7, 1200, sha(a), "response", None),
                     (7, 1300, sha(b), "response", None), (3, 1300, sha(b), "revisit", 7), (4, 2000, sha("x" * 2000), "response", None),
                     (5, 0, sha(""), "response", None)}
    urls = {r["record_id"]: r["target_uri"] for r in warc.read_archives(spark, path).collect()}
    assert urls["<urn:page:1>"] == "http://x/%C2%85Content-Length:%205%E2%80%A8Content-Length:%205%0DContent-Length:%205%0D%0A%0D%0AWARC/1.0%0D%0A%20ü🙂"


def test_text_ids(spark):
    pages = spark.createDataFrame([("a b>\r\n", "u", "x" * 1000), ("b", "u", "x" * 1000)], "page_id string, url string, html string")
    found = {(r["page_id"], r["refers_to"]) for r in warc.round_trip(pages, new_path(spark, "test")).collect()}
    assert found == {("a b>\r\n", "b"), ("b", None)}


def test_a_broken_chain_does_not_pass_in_silence(spark, tmp_path, small_splits):
    record = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    good = record.format(5, "hello") * 200
    for name, data, kept in (("whole", good, 200), ("short", good + record.format(4, "hello") + good, 201), ("headless", good[:-30], 199), ("cut", good[:-6], 200), ("junk", "junk" + good, 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text(data, newline="")
        if name == "whole":
            assert warc.read_archives(spark, str(tmp_path / name), strict=True).count() == kept
            continue
        with pytest.raises(ValueError, match="bytes"):
            warc.read_archives(spark, str(tmp_path / name), strict=True)
        with pytest.warns(UserWarning, match="bytes"):
            assert warc.read_archives(spark, str(tmp_path / name)).count() == kept


def test_blocks_hold_the_payload(spark):
    pages = spark.createDataFrame([(1, "u", "<p>ü"), (2, "v", "b" + FAKE)], "page_id bigint, url string, html string")
    path = warc.write_archives(pages, new_path(spark, "test"))
    found = {r["record_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(found["<urn:page:2>"]["block"]).decode().endswith("b" + FAKE) and found["<urn:page:1>"]["target_uri"] == "u"
    assert set(found) == {"<urn:page:1>", "<urn:page:2>"}


def items(spark, short=False):
    random.seed(8)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    size = (lambda: random.randint(5, 11)) if short else (lambda: random.randint(15, 50))
    return [(i, " ".join(random.choice(words) for _ in range(size()))) for i in range(40)], words


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        p = random.randrange(len(words))
        kind = random.randrange(3)
        if kind == 0:
            words[p] = "zz"
        elif kind == 1:
            words.insert(p, "qq")
        elif len(words) > 1:
            del words[p]
    return " ".join(words)


@pytest.mark.parametrize("short", [False, True])
def test_leaks_against_brute_force(spark, short):
    bench, words = items(spark, short)
    docs = []
    for d in range(150):
        body = [random.choice(words) if random.random() < 0.4 else f"other{random.randrange(5000)}" for _ in range(120)]
        if d % 2:
            i, text = random.choice(bench)
            body[60:60] = edited(text, random.randint(0, int(0.2 * len(text.split())))).upper().split()
        docs.append((d, " ".join(body) + ".", None))
    matcher = decontam.Matcher(bench)
    truth = set()
    for d, text, _ in docs:
        ids = [matcher.ids.get(w, 0) for w in decontam.words_of(text)]
        truth |= {(d, matcher.numbers[n]) for n in range(len(matcher.words)) if matcher.verify(ids, n, 0, len(ids)) <= matcher.limit[n]}
    frame = spark.createDataFrame(bench, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs_of(spark, docs), frame).collect()}
    assert found <= truth and len(found) >= 0.95 * len(truth) and len(truth) >= 70


@pytest.mark.parametrize("kinds", ["s", "sid", "even"])
def test_recall_by_item_length_among_unknown_words(kinds):
    """Copies with as many edits as are allowed, at random or evenly placed, and words of no item around them."""
    for n in (5, 6, 9, 10, 11, 12, 13, 14, 15, 16, 20, 30, 50):
        random.seed(n)
        bench = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i in range(150)]
        texts = []
        for i, text in bench:
            words, k = text.split(), n // 5
            at = [(j + 1) * (n + 1) // (k + 1) - 1 for j in range(k)] if kinds == "even" else random.sample(range(n), k)
            for p in sorted(at, reverse=True):
                words[p : p + 1] = {"s": ["zz"], "i": [words[p], "zz"], "d": []}["s" if kinds == "even" else random.choice(kinds)]
            texts.append(" ".join([*(f"u{i}b{j}" for j in range(20)), *words, *(f"u{i}a{j}" for j in range(20))]))
        found = list(decontam.Matcher(bench).matches(texts))
        assert sum(i in got for i, got in enumerate(found)) >= 0.99 * len(bench), n


def test_edit_distance_of_stretches():
    random.seed(9)
    matcher = decontam.Matcher([(1, "a b c d e f g")])
    for _ in range(100):
        text = [random.choice("abcdefgx") for _ in range(random.randint(0, 15))]
        ids = [matcher.ids.get(w, 0) for w in text]
        word = list("abcdefg")
        row = list(range(len(word) + 1))
        least = row[-1]
        for c in text:
            new = [0]
            for j, w in enumerate(word, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != c)))
            row, least = new, min(least, new[-1])
        assert matcher.verify(ids, 0, 0, len(ids)) == least


def test_leaks_of_messy_rows(spark, messy, empty):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, " ".join(f"word{i}" for i in range(100, 130))), (5, " ".join(f"word{i}" for i in range(100, 130)))], "item_id bigint, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(messy, frame).collect())
    assert found == [(6, 4), (6, 5), (7, 4), (7, 5)]
    kept = decontam.keep_clean(messy, frame)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 2
    assert decontam.find_leaks(empty, frame).count() == 0 and decontam.find_leaks(messy, frame.limit(0)).count() == 0


def test_leaks_of_short_items_and_unspaced_scripts(spark):
    han, thai = "地球は太陽の周りを一年かけて回る惑星である", "ประเทศไทยมีเมืองหลวงชื่อกรุงเทพมหานคร"
    frame = spark.createDataFrame([(1, "Zurich"), (2, "forty two grams"), (3, han), (4, thai)], "item_id bigint, text string")
    docs = [(1, "It is in zurich, he said", None), (2, "Zurichs forty or two grams", None), (3, "just forty-two, forty two grams.", None),
            (4, "問題：" + han.replace("太陽", "大陽") + "。はい", None), (5, "ครับ" + thai + "ครับ", None), (6, "月は地球の周りを回る", None)]
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs_of(spark, docs), frame).collect()}
    assert found == {(1, 1, 0), (3, 2, 0), (4, 3, 1), (5, 4, 0)}


def test_blocks_give_the_same_leaks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "JOINED", 3)
    bench, _ = items(spark)
    docs = docs_of(spark, [(i, "before it " + edited(t, i % 3) + " after", None) for i, t in bench])
    frame = spark.createDataFrame(bench, "item_id bigint, text string")
    blocks, _ = decontam.blocks_of(frame, 250)
    assert blocks.count > 3
    one, many = ({tuple(r) for r in decontam.find_leaks(docs, frame, block_words=n).collect()} for n in (10**6, 250))
    assert {(i, i) for i, _ in bench} <= {r[:2] for r in one}
    assert {r[:2] for r in one} == {r[:2] for r in many}


def test_pipeline(spark, tmp_path):
    random.seed(10)
    make = lambda n: " ".join(random.choice(("the", "house", "green", "water", "walking", "under")) + str(random.randrange(900)) for _ in range(n))
    leak = make(30)
    base = make(200)
    rows = [(1, base, "en"), (2, base, "en"), (3, "  " + base.replace(" ", "  "), "en"), (4, base + " more", "en"), (5, make(200), "en"),
            (6, make(50) + " " + leak + " " + make(50), "en"), (7, "123 456", "en"), (8, None, "en"), (9, make(150), "de")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, v, "s", 0) for i, t, v in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # Of the copies 1, 2 and 3 and the near copy 4 the least id stays; 6 holds the item, 7 and 8 no letter.
    near = lambda t: simhash.fingerprint(t) ^ simhash.fingerprint(base)
    assert bin(near(base + " more") % (1 << 64)).count("1") <= 4
    assert set(found) == {1, 5, 9} and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found.values())
    model = sentencepiece.Model.load()
    texts = {i: t for i, t, _ in rows}
    assert all(r["ids"] == model.encoder.encode(texts[i]).tolist() and r["lang"] in ("en", "de") for i, r in found.items())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())
