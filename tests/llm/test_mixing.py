"""Mixing: targets by repeated resharing, words taken, order of the mix, and reruns."""

import hashlib
import random
import re

import pytest

from graphloom.llm import common
from graphloom.llm import mixing as X
from tests.llm import data

WORD = re.compile("[^\x20\x09-\x0d]+")


def reshared(sizes):
    """Targets by the rule as told: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: X.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def source_sizes(rows):
    found = {}
    for _, text, _, source in rows:
        found[source] = found.get(source, 0) + len(WORD.findall(text or ""))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixture(spark, seed):
    rng = random.Random(seed)
    rows = data.documents(seed) + [(500 + k, data.prose(rng, "en", rng.randint(1, 300)), "en", rng.choice(["a", "b", "ä", "z"])) for k in range(40)]
    sizes = source_sizes(rows)
    targets = reshared(sizes)
    found = X.mixture(data.frame(spark, rows)).collect()
    by = {k: s for k, _, _, s in rows}
    taken = {}
    for r in found:
        source = by[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert len(found) == len(rows)
    assert sum(taken.values()) == sum(sizes.values())  # the budget, to the word
    assert all(abs(taken[s] - targets[s]) <= 1.5 * X.PACKET for s in sizes)
    again = X.mixture(data.frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_mix_is_in_order_and_fair(spark):
    rng = random.Random(9)
    rows = [(k, data.prose(rng, "en", 10), "en", "abc"[k % 3]) for k in range(600)]
    sizes = source_sizes(rows)
    mixed = sorted(X.mix(X.queue(data.frame(spark, rows))).collect(), key=lambda r: r["at"])
    assert [r["finish"] for r in mixed] == sorted(r["finish"] for r in mixed)
    assert mixed[0]["at"] == 0 and all(a["at"] + a["words"] == b["at"] for a, b in zip(mixed, mixed[1:], strict=False))
    targets, so_far = reshared(sizes), dict.fromkeys(sizes, 0)
    for k, r in enumerate(mixed):
        so_far[r["source"]] += r["words"]
        if k > 100:
            shares = [so_far[s] / targets[s] for s in sizes]
            assert max(shares) - min(shares) < 0.06
    half = X.mix(X.queue(data.frame(spark, rows)), budget=sum(sizes.values()) // 2)
    assert half.agg({"words": "sum"}).first()[0] == sum(sizes.values()) // 2


def direct_mix(rows):
    """(doc_id, copy): words and first place, by one queue over all packets; ids are unique and no source is null."""
    sizes, targets = source_sizes(rows), reshared(source_sizes(rows))
    queue = []
    for source in sizes:
        ahead = 0
        for k, text, _, _ in sorted((r for r in rows if r[3] == source), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            n = len(WORD.findall(text or ""))
            for copy in range(3):
                for piece, start in enumerate(range(0, n, X.PACKET)):
                    words = min(X.PACKET, n - start)
                    queue.append(((ahead + copy * sizes[source] + start + words) / targets[source], source, ahead, copy, piece, k, words))
            ahead += n
    left, at, found = sum(sizes.values()), 0, {}
    for _, _, _, copy, _, k, words in sorted(queue):
        if left:
            taken, first = found.get((k, copy), (0, at))
            found[k, copy] = taken + min(words, left), first
            at, left = at + min(words, left), left - min(words, left)
    return found


def test_the_cut_is_global(spark):
    """All packets of all sources are one queue, which ends where the budget does, within a packet of any source."""
    rng = random.Random(13)
    rows = [(k, data.prose(rng, "en", rng.choice([3, 40, 300, 1_000])), "en", rng.choice("aaabc")) for k in range(90)]
    expected = direct_mix(rows)
    queued = X.queue(data.frame(spark, rows))
    ids = {r["row"]: r["doc_id"] for r in queued.collect()}
    found = {(ids[r["row"]], r["copy"]): (r["words"], r["at"]) for r in X.copies(queued).collect()}
    assert found == expected
    taken, first = {}, {}
    for (k, _), (words, at) in expected.items():
        taken[k], first[k] = taken.get(k, 0) + words, min(at, first.get(k, at))
    assert {r["doc_id"]: (r["taken"], r["first_at"]) for r in X.mixture(data.frame(spark, rows)).collect()} == {r[0]: (taken.get(r[0], 0), first.get(r[0])) for r in rows}


def test_targets_in_closed_form(spark):
    rng = random.Random(11)
    for _ in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 500, 20_000]) for k in range(rng.randint(1, 12))} | {None: rng.choice([0, 7, 300])}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        found = {r["source"]: r["target"] for r in X.targets(frame).collect()}
        expected = reshared(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert found == {s: pytest.approx(t, rel=1e-12) for s, t in expected.items()}


def stage_order(docs):
    """(doc_id, place) of each copy taken."""
    queued = X.queue(docs.select("doc_id", "source", "text", X.content_hash(docs, 1).alias("a"), X.content_hash(docs, 2).alias("b")), "a", "b")
    return [(r["doc_id"], r["at"]) for r in X.copies(queued).join(queued.select("row", "doc_id"), "row").collect()]


def test_stage(spark):
    rows = data.documents()
    docs = data.frame(spark, rows)
    mixed = X.stage(spark, docs, "")
    assert mixed.columns == docs.columns
    assert [r["doc_id"] for r in mixed.collect()] == [k for k, _ in sorted(stage_order(docs), key=lambda x: x[1])]
    taken = {r["doc_id"]: r["taken"] for r in X.mixture(docs).collect()}
    got = {}
    texts = {r[0]: r[1] for r in rows}
    for r in mixed.select("doc_id", "text").collect():
        assert texts[r["doc_id"]].startswith(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert got == {k: n for k, n in taken.items() if n}
    twice = data.frame(spark, rows + rows + [(None, "no id here", "en", "s0")])
    assert X.stage(spark, twice, "").count() > 0


def test_stage_counts_rows_of_one_id_apart(spark):
    rng = random.Random(6)
    rows = [(k, data.prose(rng, "en", 40), "en", "s0") for k in range(20)] + [(3, data.prose(rng, "en", 25), "en", "s0"), (3, data.prose(rng, "de", 40), "de", "s0"), (None, "no id", "en", "s0"), (None, "no id", "en", "s0")]
    mixed = [sorted(r["text"] for r in X.stage(spark, data.frame(spark, own), "").collect()) for own in (rows, rows[::-1])]
    assert mixed[0] == sorted(t for _, t, _, _ in rows)  # one source: all of it, once
    assert mixed[1] == mixed[0]


def test_rows_that_repeat_and_columns_named_like_the_stages_own(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rng = random.Random(7)
    rows = [(k, data.prose(rng, "en", 40), "en", f"s{k % 2}") for k in range(12)]
    rows += [(None, "once more and again", "en", "s1")] * 2_500 + [(5, rows[5][1], "en", "s1")]
    docs = data.frame(spark, rows).selectExpr("*", "1 as _words", "2 as _size", "3 as _key", "4 as A", "5 as b", "6 as at", "7 as several", "8 as salt", "9 as row", "10 as source_size")
    mixed = X.stage(spark, docs, "")
    assert mixed.columns == docs.columns and {r["_key"] for r in mixed.select("_key").collect()} == {3}
    texts = [r["text"] for r in mixed.collect()]
    assert sum(len(WORD.findall(t)) for t in texts) == sum(source_sizes(rows).values())
    assert texts == [r["text"] for r in X.stage(spark, docs.repartition(5), "").collect()]


def test_empty(spark):
    docs = data.frame(spark, [])
    assert X.mixture(docs).count() == 0 and X.stage(spark, docs, "").count() == 0
    assert [r["target"] for r in X.mixture(data.frame(spark, [(1, "", "en", "s"), (2, None, "en", None)])).collect()] == [0.0, 0.0]
