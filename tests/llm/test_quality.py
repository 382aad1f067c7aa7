"""Quality: held-out accuracy, the discriminant against scipy-free formulas, edge cases."""

import random
import zlib

import numpy as np
import pytest

from graphloom.llm import quality as K
from tests.llm import data


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        text, good = data.prose(rng, "en", rng.randint(20, 200)), rng.random() < 0.7
        if not good:
            words = text.split(" ")
            text = rng.choice([" ".join(f"{w}###" for w in words), text.upper().replace(" ", "!! "), " ".join([words[0]] * len(words)), " | ".join(words)])
        rows.append((k, text, "en", "s"))
        labels.append((k, int(good), 0))
    labels += [(0, None, 1), (1, 7, 0), (9999, 1, 0), (None, 1, 0), (5, labels[5][1], 0)]
    more = [(600, None, None, None), (601, "", "en", "s"), (602, "word " * 50_000, "en", "s"), (603, "x", "en", "s")]
    return rows, labels, data.frame(spark, rows + more), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables, tmp_path):
    rows, labels, docs, known = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"]: r for r in K.op10_quality(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) + 4
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    out = [(found[k]["predicted"], q) for k, q, _ in labels[:400] if found[k]["held_out"]]
    assert len(out) > 80 and sum(a == b for a, b in out) / len(out) > 0.97
    assert found[600]["score"] == found[601]["score"]


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    d = len(K.FEATURES)
    x = {k: rng.normal(k, 1 + k, (500, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    model = K.Discriminant.fit({k: (500, v.sum(0), v.T @ v) for k, v in x.items()}, pooled=0.0, ridge=0.0)
    at = np.vstack([x[0][:5], x[1][:5]])
    z = (at - model.centre) / model.scale

    def density(k):
        own = (x[k] - model.centre) / model.scale
        mean, cov = own.mean(0), np.cov(own.T, bias=True)
        gap = z - mean
        return -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(0.5)

    expected = 1 / (1 + np.exp(-(density(1) - density(0)) / d))
    assert np.allclose(model.scores(at), expected, rtol=1e-6)


def test_degenerate_classes(spark, tables):
    rows, labels, docs, known = tables
    assert {r["score"] for r in K.classify(docs, known.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in K.classify(docs, known.where("quality = 1")).collect()} == {1.0}
    assert K.classify(data.frame(spark, []), known).count() == 0
    same = K.Discriminant.fit({k: (3, np.full(len(K.FEATURES), 3.0), np.full((len(K.FEATURES),) * 2, 3.0)) for k in (0, 1)})
    assert np.isfinite(same.scores(np.zeros((1, len(K.FEATURES))))).all()


def test_statistics():
    assert all(np.isfinite(K.statistics(t)).all() for t in (None, "", " ", "\n\n", "a", "!" * 1000, "日本 é", "\x00"))
    assert len(K.statistics("a b")) == len(K.FEATURES)


def plain_statistics(text):
    """The statistics one by one, as their names say."""
    text = text or ""
    size = max(1, len(text.encode()))
    words = text.split()
    n = max(1, len(words))
    share = lambda wanted: sum(wanted(c) for c in text) / size
    count = lambda wanted: sum(1 for w in words if wanted(w))
    most = lambda wanted: max([words.count(w) for w in set(words) if wanted(w)], default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "log_words": np.log(1 + len(words)),
        "word_length": np.log(1 + len(text) / n),
        "upper": share(lambda c: "A" <= c <= "Z") ** 0.5,
        "digit": share(lambda c: c in "0123456789") ** 0.5,
        "sign": share(lambda c: c in "#$%&()*+/<=>@[\\]^_`{}~") ** 0.5,
        "shout": share(lambda c: c == "!") ** 0.5,
        "bar": share(lambda c: c == "|") ** 0.5,
        "stop": share(lambda c: c in ".,;:?") ** 0.5,
        "distinct": len(set(words)) / n,
        "top_word": (most(lambda w: True) / n) ** 0.5,
        "top_sign_word": (most(lambda w: not w.isalpha()) / n) ** 0.5,
        "same_neighbour": (sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) ** 0.5,
        "neighbour_pairs": len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / n,
        "line_repeats": (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        "log_line": np.log(1 + len(text) / max(1, len(lines))),
        "sign_ends": (count(lambda w: not w[-1].isalnum() and w[-1] not in ".,;:?'\"") / n) ** 0.5,
        "upper_words": (count(lambda w: w.isupper()) / n) ** 0.5,
        "long_words": (count(lambda w: len(w) > 15) / n) ** 0.5,
    }


def test_statistics_one_by_one(tables):
    rows = tables[0]
    texts = [r[1] for r in rows[:60]] + [r[1] for r in data.documents()] + ["a\na\n\nb a|b!! #x# 12 12 ÄÖ", "\\ ~ ` ^", "averyveryverylongword x"]
    for text in texts:
        plain = plain_statistics(text)
        assert list(plain) == list(K.FEATURES)
        assert np.allclose(K.statistics(text), list(plain.values()), rtol=1e-12, atol=0), text


def test_shrunk_scores_by_their_formula(spark, tables):
    """The whole operator against statistics, shrinkage and densities computed directly."""
    rows, labels, docs, known = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {k: np.array(list(plain_statistics(t).values())) for k, t in texts.items()}
    learned = [(k, q) for k, q, _ in labels if k in x and q in (0, 1) and zlib.crc32(str(k).encode()) % 3 != 1]
    every = np.array([x[k] for k, _ in learned])
    centre, scale = every.mean(0), every.std(0)
    scale[scale**2 <= 1e-12] = 1
    own = {c: (np.array([x[k] for k, q in learned if q == c]) - centre) / scale for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * cov[c] for c in (0, 1)) / len(learned)
    d = len(K.FEATURES)

    def density(z, c):
        shrunk = 0.95 * (0.8 * cov[c] + 0.2 * pooled) + 0.05 * np.eye(d)
        gap = z - own[c].mean(0)
        return np.log(len(own[c]) / len(learned)) - 0.5 * (gap @ np.linalg.solve(shrunk, gap) + np.linalg.slogdet(shrunk)[1])

    for r in K.classify(docs, known).collect():
        z = (x[r["doc_id"]] - centre) / scale
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(density(z, 1) - density(z, 0)) / d)), rel=1e-6, abs=1e-9)
