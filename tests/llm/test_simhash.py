"""SimHash: fingerprints and classes against a direct computation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from graphloom.llm import common
from graphloom.llm import simhash as H
from graphloom.operators.components import connected_components
from tests.llm import data


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=4):
    marks = [fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for k, (key, *_) in enumerate(rows):
        root = find(k)
        least[root] = min((x for x in (key, least.get(root)) if x is not None), default=None)
    return sorted(((key, f"{m:016x}", least[find(k)]) for k, ((key, *_), m) in enumerate(zip(rows, marks, strict=True))), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    rows = data.documents(seed)
    base = data.prose(rng, "en", 300).split(" ")
    for k in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "s"))
    return rows + [rows[0], (None, rows[1][1], "en", "s"), (None, "only without id", "en", "s"), (-3, "", "en", "s")]


def test_classes(spark):
    rows = near_copies(1)
    found = sorted(map(tuple, H.near_duplicates(data.frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert found == classes(rows)


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_links_lose_none(spark, parts):
    rng = random.Random(parts)
    marks = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for m in list(marks)[:60]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                m ^= 1 << b
            marks.add(m)
    ordered = sorted(marks)
    frame = spark.createDataFrame([(int(np.uint64(m).astype(np.int64)),) for m in ordered], "fp long")
    linked = connected_components(H.links(frame, 4, parts=parts, tile_rows=20)).collect()
    groups = {}
    for r in linked:
        groups.setdefault(r["component"], set()).add(int(np.int64(r["id"]).astype(np.uint64)))
    direct = {}
    for _, mark, least in classes_of(ordered):
        direct.setdefault(least, set()).add(mark)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in direct.values() if len(g) > 1)


def classes_of(marks):
    parent = list(range(len(marks)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [(k, m, find(k)) for k, m in enumerate(marks)]


def test_links_are_cut_down_before_they_are_written(spark):
    marks = [1 << k for k in range(60)]  # all within two bits, in some 30 tiles, so that each is in many pairs of tiles
    found = H.links(spark.createDataFrame([(m,) for m in marks], "fp long"), 4, tile_rows=2).select("u", "v", F.input_file_name().alias("f"))
    rows = found.collect()
    assert all(r["u"] != r["v"] for r in rows)
    for f in {r["f"] for r in rows}:
        own = [(r["u"], r["v"]) for r in rows if r["f"] == f]
        assert len(own) == len({u for u, _ in own}) < len(marks)
    assert {r["component"] for r in connected_components(found.select("u", "v")).collect()} == {1}


def test_near_cells():
    for parts in (1, 2, 4):
        cells = H._near_cells(parts, 4)
        assert len(cells) == len(set(map(tuple, cells))) and all(sum(map(abs, c)) <= 4 for c in cells)
        ball = {1: 9, 2: 41, 4: 321}[parts]
        assert len(cells) == (ball + 1) // 2


def test_forest_is_small():
    marks = np.array([1 << k for k in range(60)], dtype=np.uint64)  # all within two bits
    u, v = H.forest(marks, None)
    assert len(u) == 59 and set(v.tolist()) == {1}
    u, v = H.forest(marks[:30], marks[30:])
    assert len(u) <= 59


@pytest.mark.parametrize(("words", "share"), [(1, 1), (common.FILTER_WORDS, common.HOT_SHARE), (1, 10**9)])
def test_stage(spark, monkeypatch, words, share):
    """Whether the filter holds back all rows or few, and whether no key is hot or every one."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = near_copies(2)
    kept = H.stage(spark, data.frame(spark, rows), "")
    assert kept.columns == data.frame(spark, rows).columns
    expected = sorted({str(k) for k, _, least in classes(rows) if k == least and k is not None})
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(str(k) for k in ids if k is not None) == expected
    assert kept.where("doc_id is null").count() == 2


def test_filter_misses_no_key(spark):
    held, all_ids = spark.range(0, 40_000, 4), spark.range(40_000)
    for words, alarms in ((1 << 20, 300), (1 << 10, 15_000)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "FILTER_WORDS", words)
            found = common.may_hold(all_ids.withColumn("slot", F.lit(1)), F.col("id"), held, "id", 10_000, "maybe")
            assert found.where("id % 4 = 0 and not maybe").isEmpty() and found.where("id % 4 <> 0 and maybe").count() <= alarms


def test_columns_named_like_the_stages_own(spark):
    docs = data.frame(spark, near_copies(2)).selectExpr("*", "1 as maybe", "2 as KEY", "3 as rows", "4 as least", "5 as gone", "6 as again", "7 as _fp", "8 as content", "9 as row", "10 as slot", "11 as mask", "12 as component")
    docs = docs.union(docs)
    kept = H.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in H.stage(spark, data.frame(spark, near_copies(2)), "").select("doc_id").collect())


def test_stage_with_one_id_for_two_texts(spark):
    rows = near_copies(3)
    texts = {k: t for k, t, *_ in rows}
    rows.append((7, texts[3], "en", "s"))  # 7 is its own class's least and a copy of 3
    assert H.stage(spark, data.frame(spark, rows), "").where("doc_id = 7").count() == 1


def test_stage_decides_per_row(spark):
    rng = random.Random(4)
    other, copied = data.prose(rng, "de", 80), data.prose(rng, "fr", 80)
    rows = near_copies(3)
    texts = {k: t for k, t, *_ in rows}
    apart = data.prose(rng, "fr", 80)
    rows += [(7, texts[3], "en", "s"), (8, other, "en", "s"), (8, other, "de", "s"), (8, apart, "en", "s"), (None, copied, "fr", "s"), (None, copied, "fr", "s")]
    found = [sorted((r["doc_id"], r["text"], r["lang"]) for r in H.stage(spark, data.frame(spark, own), "").where("doc_id in (3, 7, 8)").collect()) for own in (rows, rows[::-1])]
    lang = {k: x for k, _, x, _ in near_copies(3)}
    assert found[0] == sorted([(3, texts[3], lang[3]), (7, texts[7], lang[7]), (8, texts[8], lang[8]), (8, other, "de"), (8, apart, "en")])
    assert found[1] == found[0]
    assert H.stage(spark, data.frame(spark, rows), "").where(f"doc_id is null and text = '{copied}'").count() == 1


def test_long_text_and_empty(spark):
    text = data.prose(random.Random(3), "en", 70_000)
    assert H.fingerprint(text) == fingerprint(text)
    assert H.near_duplicates(data.frame(spark, [])).count() == 0
