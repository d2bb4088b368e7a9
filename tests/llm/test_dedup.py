"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cellwise.llm import exact_dedup, simhash
from cellwise.llm.components import components
from tests.llm.conftest import docs_of


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(messy, bits):
    """With three bits of hash nearly all chunks collide, and verification tells them apart."""
    rows = [(r["doc_id"], norm(r["text"])) for r in messy.select("doc_id", "text").collect()]
    found = exact_dedup.exact_groups(messy, bits).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    for sha, ids in groups.items():
        assert sum(r["kept"] for r in found if r["text_sha256"] == sha) == 1


def test_chunks_make_up_the_text(spark):
    texts = ["", "a" * 9000, "The end. " * 900, "héllo wörld done. " * 300, "\n" * 5000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(1 <= len(c) <= exact_dedup.MAX_CHUNK for c in r["c"])


def test_keep_first(messy, empty):
    kept = exact_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    assert len(rows) == len({norm(r["text"]) for r in messy.collect()})
    assert all(r["_row"] == "x" and r["_again"] == 4 for r in rows)
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_fingerprint_follows_its_definition(spark, messy):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for r in messy.select("text").collect():
        assert simhash.fingerprint(r["text"]) % (1 << 64) == slow(r["text"])
    assert simhash.fingerprint("Ä b\x0bc") % (1 << 64) == slow("Ä b\x0bc")
    same = spark.createDataFrame([("one two",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("ONE\ttwo") == same


def classes(fps, distance=4):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) % (1 << 64)).count("1") <= distance:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize(("small", "large"), [(32, 8192), (2, 8192), (2, 3), (32, 10)])
def test_links_lose_nothing(spark, small, large):
    """Spread out, clustered and chained fingerprints, by each of the ways for crowded keys."""
    random.seed(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = {random.getrandbits(64) for _ in range(80)}
    centre = random.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for _ in range(60)}
    at = random.getrandbits(64)
    for _ in range(12):
        at ^= sum(1 << b for b in random.sample(range(64), 4))
        fps.add(at)
    fps = {signed(f) for f in fps}
    truth = classes(fps)
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "doc_id bigint, fp bigint")
    found = simhash.near_groups(rows, small=small, large=large).collect()
    least = {}
    for r in found:
        least[truth[r["fp"]]] = min(r["doc_id"], least.get(truth[r["fp"]], r["doc_id"]))
    assert len(found) == len(fps) and all(r["component_id"] == least[truth[r["fp"]]] for r in found)


def test_block_choices_cover_every_close_pair():
    random.seed(2)
    for distinct in (1, 10**8, 10**11):
        blocks = simhash.blocks_for(distinct)
        masks = simhash.block_masks(blocks)
        for _ in range(300):
            x = sum(1 << b for b in random.sample(range(64), 4))
            assert any((x & m) % (1 << 64) == 0 for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(messy, empty):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    found = simhash.near_classes(messy)
    assert found.count() == messy.count()
    assert kept.count() == found.select("root").distinct().count()
    ids = {r["root"]: r["component_id"] for r in found.collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, ids.values()))
    assert simhash.keep_one(empty).count() == 0 and simhash.near_classes(empty).count() == 0


def test_keep_one_of_each_class_whatever_the_ids(spark):
    """Unlike texts under null or equal ids are classes of their own; near copies are still one."""
    random.seed(12)
    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, texts[0], "en"), (None, texts[1], "en"), (None, texts[2], "en"), (7, texts[3], "en"), (7, texts[4], "en"), (7, texts[5], "en"),
            (None, texts[5], "en"), (None, texts[0].upper(), "en"), (9, texts[6], "en"), (8, texts[6], "en"), (None, texts[6], "en"), (7, texts[7], "en"), (7, texts[7], "en")]
    kept = [(r["doc_id"], r["text"].lower()) for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    key = lambda r: (r[0] or 0, r[1])
    expected = [(None, t) for t in texts[:3]] + [(7, t) for t in (*texts[3:6], texts[7])] + [(8, texts[6])]
    assert sorted(kept, key=key) == sorted(expected, key=key)
