"""Decontamination against a direct search."""

import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import decontamination as D
from tests.llm import data


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        n = min(13, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                if item is not None:
                    found.add(str(item))
    listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return (len(own), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(own))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    items = [(k, data.prose(rng, "en", rng.choice([1, 2, 3, 5, 12, 13, 14, 40]))) for k in range(30)]
    items += [(100, items[0][1]), (101, None), (102, " ... "), (None, data.prose(rng, "fr", 20)), (103, "Ünï-cödé 42 x"), (104, " ".join(["la"] * 20)), (105, items[7][1])]
    docs = data.documents()
    for k in range(80):
        item = rng.choice(items)[1] or ""
        cut = words(item)
        start = rng.randint(0, max(0, len(cut) - 13))
        piece = " ".join(cut[start : start + rng.choice([12, 13, 20])])
        docs.append((200 + k, data.prose(rng, "en", rng.randint(0, 80)) + " " + rng.choice([item, piece, piece.upper(), piece.replace(" ", " -- ")]) + " " + data.prose(rng, "en", 5), "en", "s"))
    docs += [(400, "la " * 30, "en", "s"), (401, "la " * 19, "en", "s"), (402, "ünï!cödé? 42_x", "en", "s"), (403, "ÜNÏ cödé 42 x", "en", "s")]
    return docs, items


def test_against_direct_search(spark, tables, monkeypatch):
    docs, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as width", "2 as mix")
    expected = {k: brute(t, items) for k, t, _, _ in docs}
    assert sum(e[4] for e in expected.values()) > 30 and sum(0 < e[1] for e in expected.values()) > sum(e[4] for e in expected.values())
    for block in (D.BLOCK_WORDS, 40):  # one block of items, or many
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        found = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(data.frame(spark, docs), benchmark).collect()}
        assert found == expected


def test_prefix_is_the_rarest_shingle():
    index = D.build([("a", " ".join(f"w{k}" for k in range(13)))])
    mixes = D._shingles(index.window(0), 4)
    order = np.argsort(mixes)
    D.order_by_rarity(index, {4: (mixes[order], np.where(order == 6, 2, 9))})
    keys, _, entries = index.by_width[4]
    assert keys.tolist() == [mixes[6]] and entries.tolist() == [[0, 6]]


def test_equal_windows_are_one_and_keep_their_items():
    text = " ".join(f"w{k}" for k in range(15))
    index = D.build([("a", text), (None, text), ("b", text + " x"), ("c", "w0"), ("d", None)])
    assert sorted(zip(index.sizes.tolist(), np.diff(index.owner_starts).tolist(), strict=True)) == [(1, 1), (13, 1), (13, 2), (13, 2), (13, 2)]


def test_stage_keeps_clean_rows(spark, tables, monkeypatch):
    docs, items = tables
    rows = docs + [(None, items[3][1], "en", "s"), docs[0]]
    for block in (D.BLOCK_WORDS, 60):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        check_clean(spark, rows, items)


def check_clean(spark, rows, items):
    kept = D.clean(data.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(k) for k, t, *_ in rows if not brute(t, items)[1])
    assert kept.columns == data.frame(spark, rows).columns


def test_stage_drops_a_short_passage_in_a_long_text(spark):
    rng = random.Random(12)
    item = " ".join(f"item{k}" for k in range(13))
    long = data.prose(rng, "en", 500) + " " + item + " " + data.prose(rng, "en", 500)
    docs, benchmark = data.frame(spark, [(1, long, "en", "s"), (2, data.prose(rng, "en", 1000), "en", "s")]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["n_hit"], r["contaminated"]) for r in D.contamination(docs, benchmark).orderBy("doc_id").collect()] == [(13, False), (0, False)]
    assert [r["doc_id"] for r in D.clean(docs, benchmark).collect()] == [2]


def test_empty(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([], "item_id long, text string")
    found = D.contamination(data.frame(spark, docs), none).collect()
    assert all(r["n_hit"] == 0 and not r["contaminated"] and r["n_words"] == len(words(dict((d[0], d[1]) for d in docs)[r["doc_id"]])) for r in found)
    assert D.contamination(data.frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
