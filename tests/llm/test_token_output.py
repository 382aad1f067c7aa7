"""Token blocks: the coder, the piecewise encoder against the library, and whole round trips."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from graphloom.llm import token_output as O
from tests.llm import data


@pytest.fixture(scope="module")
def encoder():
    return O.Encoder(O.tokenizer_path())


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids + [O.END_ID]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), st.characters(exclude_categories=("Cs",)), st.sampled_from(" '\ńÀéßÉ.,!%1aZ")), max_size=40))
@example("it's 'S ''s don't!'re <|endoftext|>x Á É̱ × a÷b ß Ǆ İ ſ \x1c\x85\xa0")
def test_pieces_equal_whole_texts(encoder, text):
    assert np.frombuffer(encoder.encode(text), dtype=encoder.dtype).tolist() == whole(encoder, text)


@pytest.mark.parametrize("top", [1, 200, 70_000, 400_000])
def test_coder(top):
    rng = np.random.default_rng(top)
    for n in (1, 2, 3, 4, 5, 1000):
        ids = rng.integers(0, top, n).astype("<u4")
        assert np.array_equal(O.decode_ranks(n, *O.encode_ranks(ids)), ids)
    many = np.arange(top, dtype="<u4")
    ranks, control, coded = O.encode_ranks(np.concatenate([many, many[-1:]]))
    assert np.frombuffer(ranks, dtype="<u4")[0] == top - 1 and len(control) == -(-(top + 1) // 4)
    assert np.array_equal(O.decode_ranks(top + 1, ranks, control, coded)[:-1], many)


def expected(encoder, rows):
    start, out = 0, []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, encoder.encode(r[1] or ""))):
        ids = whole(encoder, text or "")
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "shard"), [(O.BLOCK_TOKENS, O.SHARD_DOCS), (300, 10), (1, 3)])
def test_round_trip(spark, encoder, tmp_path, monkeypatch, block, shard):
    monkeypatch.setattr(O, "BLOCK_TOKENS", block)
    monkeypatch.setattr(O, "SHARD_DOCS", shard)
    rows = data.documents()
    random.Random(0).shuffle(rows)
    rows += [(None, "no id", "en", "s"), (None, None, "en", "s"), rows[0], (rows[1][0], "same id", "en", "s"), (-5, "below zero", "en", "s")]
    O.write_tokens(data.frame(spark, rows), str(tmp_path / "t"), O.tokenizer_path())
    found = sorted(map(tuple, O.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str)
    assert found == expected(encoder, [(r[0], r[1]) for r in rows])


def test_files_in_order_have_ascending_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "SHARD_DOCS", 20)
    rows = [(k * 37 % 501, f"text {k}", "en", "s") for k in range(400)] + [(None, f"none {k}", "en", "s") for k in range(90)]
    O.write_tokens(data.frame(spark, rows).repartition(7), str(tmp_path / "t"), O.tokenizer_path())
    ids = []
    for file in sorted((tmp_path / "t").glob("*.parquet")):
        for row in pq.read_table(file).to_pylist():
            own = np.frombuffer(row["doc_ids"], dtype="<i8").tolist()
            ids += [-1] * row["null_ids"] + own[row["null_ids"] :]
    assert ids == sorted(ids) and len(ids) == len(rows) and len(list((tmp_path / "t").glob("*.parquet"))) > 1


def test_one_id_fills_several_shards(spark, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "SHARD_DOCS", 20)
    rows = [(k, f"text {k}", "en", "s") for k in range(100)] + [(50, f"same id {k}", "en", "s") for k in range(200)] + [(None, f"none {k}", "en", "s") for k in range(100)]
    starts = []
    for parts in (2, 5):
        path = str(tmp_path / str(parts))
        O.write_tokens(data.frame(spark, rows).repartition(parts), path, O.tokenizer_path())
        assert spark.read.parquet(path).groupBy("shard").agg({"n_tokens": "sum"}).count() > 10
        found = sorted(map(tuple, O.read_tokens(spark, path).collect()), key=lambda r: r[1])
        ids = [-1 if r[0] is None else r[0] for r in found]
        assert ids == sorted(ids) and all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:], strict=False))
        starts.append(found)
    assert starts[0] == starts[1]


def test_full_generations_change(monkeypatch):
    encoder = O.Encoder(O.tokenizer_path())
    monkeypatch.setattr(O, "CACHE_WORDS", 5)
    text = data.documents()[61][1]
    assert np.frombuffer(encoder.encode(text), dtype=encoder.dtype).tolist() == whole(encoder, text)
    assert len(encoder.pieces) <= 5 and 0 < len(encoder.pieces.old) <= 5


def test_empty(spark, tmp_path):
    O.write_tokens(data.frame(spark, []), str(tmp_path / "t"), O.tokenizer_path())
    assert O.read_tokens(spark, str(tmp_path / "t")).count() == 0
