"""Language identification: held-out accuracy, filter properties, and edge cases."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import language_id as L
from tests.llm import data


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(k, data.prose(rng, lang, rng.randint(5, 60)), lang, "s") for k in range(240) for lang in [rng.choice(list(data.ROOTS))]]
    return rows, data.frame(spark, rows + [(900, None, "en", "s"), (901, "", None, "s"), (902, "1 2 3", "de", "s"), (903, "日本", None, "s")])


def test_predictions(spark, labelled, tmp_path):
    rows, docs = labelled
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in L.op1_language_id(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) + 4
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    wrong = [k for k, _, lang, _ in rows if found[k]["held_out"] and found[k]["lang_pred"] != lang]
    assert sum(r["held_out"] for r in found.values()) > 40 and not wrong
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (900, 901, 902))
    assert found[903]["lang_pred"] in data.ROOTS
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_filter_has_no_false_negatives_and_known_false_positives():
    rng = np.random.default_rng(1)
    own = [(f"l{k}", rng.integers(0, 1 << 63, 2000, dtype=np.uint64)) for k in range(70)]
    bloom = L.BitSlicedBloom.build(own)
    assert bloom.rows.shape[0] == 2  # more than 64 languages take a second word
    for k in (0, 63, 64, 69):
        bits = bloom.lookup(own[k][1])[k // 64] >> np.uint64(k % 64) & np.uint64(1)
        assert bits.all()
        assert np.argmax(bloom.shares(own[k][1])) == k
    other = bloom.lookup(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    rate = np.count_nonzero(other[0] & np.uint64(1)) / 50_000
    assert abs(rate - bloom.chance[0]) < 0.002
    assert bloom.shares(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)).max() < 0.002


def test_grams():
    assert L.grams(None) is None and L.grams(" 12 _ !") is None
    assert len(L.grams("a")) == 1 and np.array_equal(L.grams("Das  Haus!"), L.grams("das, HAUS"))
    assert len(L.grams("x" * 100_000)) == 99_999


def test_letters_are_those_of_unicode():
    assert all(L.grams(t) is None for t in ("①", "½", "²", "Ⅷ 7", "\u0941", "_"))  # number signs, a lone vowel sign
    assert len(L.grams("हिन्दी")) == len(" हिन्दी ") - 3  # marks belong to their word
    assert not np.array_equal(L.grams("ไทย"), L.grams("ไ ทย"))


def plain_grams(text):
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    spaced = f" {' '.join(kept.split())} "
    return [spaced[k : k + 4] for k in range(max(1, len(spaced) - 3))] if any(unicodedata.category(c)[0] == "L" for c in kept) else []


def plain_sets(rows):
    """The n-grams that each language of (text, lang) contains, and how many rows it has."""
    counts, seen = {}, Counter()
    for text, lang in rows:
        if lang is not None:
            seen[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    share = {lang: {g: n / own.total() for g, n in own.items() if n / own.total() >= L.MIN_SHARE} for lang, own in counts.items()}
    total = Counter()
    for own in share.values():
        total.update(own)
    return {lang: {g for g, x in own.items() if x / total[g] >= L.OWN_SHARE} for lang, own in share.items()}, seen


def test_against_plain_sets(spark, labelled):
    """Shares and labels against sets of n-grams: the filter may add chance hits only, and its correction takes them off."""
    rows, docs = labelled
    model = L.fit(docs)
    contained, seen = plain_sets((r["text"], r["lang"]) for r in docs.collect())
    assert model.labels == sorted(seen, key=lambda x: (-seen[x], x))
    for text in [r[1] for r in rows] + ["the und que", "Zq Xk!", "Ärger d'été ①", "日本 the"]:
        own = plain_grams(text)
        exact = np.array([sum(g in contained[lang] for g in own) / len(own) for lang in model.labels])
        masks, found = model.lookup(L.grams(text))[0], model.shares(L.grams(text))
        hits = np.array([np.count_nonzero(masks >> np.uint64(k) & np.uint64(1)) for k in range(len(model.labels))])
        assert (hits >= np.round(exact * len(own))).all()  # nothing contained is missed
        assert np.abs(found - exact).max() <= 3 / len(own) + 0.01
        label, score, _ = model.decide(text)
        if np.sort(exact)[-1] - np.sort(exact)[-2] > 0.1:
            assert label == model.labels[int(np.argmax(exact))] and score == pytest.approx(exact.max() / exact.sum(), abs=0.1)


def test_training_is_bounded_and_ignores_labels_left_out(spark, labelled):
    rows, docs = labelled
    model = L.fit(docs, train_docs=20)
    assert sorted(model.labels) == sorted(data.ROOTS)
    assert model.labels[0] == max(data.ROOTS, key=[r[2] for r in rows].count)
    assert sum(model.decide(t)[0] == lang for _, t, lang, _ in rows) >= 0.98 * len(rows)


def test_no_id_or_text_breaks_the_bound(spark):
    rng = random.Random(2)
    rows = [(k, data.prose(rng, "en", 20), "en", "s") for k in range(60)] + [(7_000, data.prose(rng, "en", 20), "en", "s") for _ in range(300)]
    rows += [(None, "same text again", "en", "s")] * 300 + [(None, data.prose(rng, "de", 20), "de", "s") for _ in range(200)]
    labelled = data.frame(spark, rows).select("doc_id", "lang", "text")
    per = labelled.groupBy("lang").count()
    held = {r["lang"]: r["count"] for r in L._sample(labelled, 50, 2, per).groupBy("lang").count().collect()}
    assert 25 <= held["en"] <= 50 and held["de"] == 50
    assert L.fit(data.frame(spark, rows), train_docs=50).decide(rows[0][1])[0] == "en"


def test_without_labels_everything_is_und(spark):
    docs = data.frame(spark, [(1, "hello there", None, None)])
    model = L.fit(docs)
    assert [r[L.LANG] for r in L.predict(docs, model).collect()] == ["und"]
    empty = data.frame(spark, [])
    assert L.predict(empty, L.fit(empty)).count() == 0


def test_stage_drops_what_is_no_language_and_keeps_the_rest(spark, labelled):
    rows, docs = labelled
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in rows}


def test_stage_keeps_short_texts_in_the_letters_of_a_learned_language(spark, labelled):
    rows, _ = labelled
    short = [(2000 + k, t, lang, "s") for k, (t, lang) in enumerate([("A.", "en"), ("Q", "de"), ("ß", "de"), ("7 x", None), ("Zq Xk!", "fr"), ("qzx " * 5, "en")])]
    foreign = [(2100, "日", None, "s"), (2101, "привет", None, "s"), (2102, "zxqj kvwq " * 30, None, "s")]
    kept = {r["doc_id"] for r in L.stage(spark, data.frame(spark, rows + short + foreign), "").select("doc_id").collect()}
    assert kept == {r[0] for r in rows + short}
