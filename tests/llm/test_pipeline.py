"""The pipeline: every stage's rows against brute force, on one small folder of tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql.readwriter import DataFrameWriter
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import language_id, mixing, token_output
from tests.llm import data
from tests.llm.test_decontamination import brute
from tests.llm.test_language_id import plain_grams, plain_sets
from tests.llm.test_simhash import classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), random.Random(8)
    items = [(k, data.prose(rng, "en", 20)) for k in range(5)]
    rows = [(k, t, lang, s, len(t or "")) for k, t, lang, s in data.documents()] + [(300 + k, items[k][1] + " " + data.prose(rng, "en", 10), "en", "s1", 0) for k in range(5)]
    spark.createDataFrame(rows, data.SCHEMA + ", n_chars long").repartition(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        made = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert made.columns == docs.columns
        docs = made
        kept[name] = before, docs
    assert list(kept) == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = kept["language_id"]
    langs = {r[0]: r[2] for r in rows}
    contained, _ = plain_sets((t, langs[k]) for k, t, _ in before if zlib.crc32(str(k).encode()) % 4 != 2)
    stayed = set(ids(after))
    for k, text, _ in before:
        own = plain_grams(text)
        share = max((sum(g in held for g in own) / len(own) for held in contained.values()), default=0) if own else 0
        if not own:
            assert k not in stayed, k
        elif len(own) < language_id.ENOUGH_GRAMS or share > language_id.REJECT_BELOW + 0.03:
            assert k in stayed, k  # all its letters are of learned scripts
        elif share < language_id.REJECT_BELOW - 0.03:
            assert k not in stayed, k
    before, after = kept["near_duplicates"]
    assert ids(after) == sorted(k for k, _, least in classes(before) if k == least)
    before, after = kept["decontamination"]
    assert ids(after) == sorted(k for k, t, _ in before if not brute(t, items)[1]) and not set(range(300, 305)) & set(ids(after))
    before, after = kept["mixing"]
    sized = spark.createDataFrame([(k, t, s) for k, t, s in before], "doc_id long, text string, source string")
    wanted = {r["doc_id"]: r["taken"] for r in mixing.mixture(sized).collect() if r["taken"]}
    got = {}
    for r in after.select("doc_id", "text").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert set(got) == set(wanted)
    before, after = kept["token_ids"]
    tokenizer, start, expected = Tokenizer.from_file(token_output.tokenizer_path()), 0, []
    made = [(k, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")) for k, t, _ in before]
    for k, tokens in sorted(made, key=lambda r: (r[0], r[1].astype("<u2").tobytes())):
        expected.append((k, start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert sorted(map(tuple, after.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(expected)


def test_run_gives_the_last_stage(spark, folder):
    path, _, _ = folder
    found = corpus_pipeline.run(spark, path).orderBy("start").collect()
    assert found[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))


def python_workers(plan: str) -> int:
    """How many Python nodes a task of this plan has above each other, at most; exchanges end a task."""
    above, most = [], 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [x for x in above if x[0] < depth]
        held = 0 if "Exchange" in line.split("[")[0] else (above[-1][1] if above else 0) + ("MapInArrow" in line)
        above.append((depth, held))
        most = max(most, held)
    return most


def test_a_task_has_one_python_worker(spark, folder, tmp_path, monkeypatch):
    assert python_workers("W\n+- MapInArrow a\n   +- Exchange b\n      :- MapInArrow c\n      +- MapInArrow d") == 1
    assert python_workers("W\n+- MapInArrow a\n   +- *(1) Project [b]\n      +- MapInArrow c") == 2
    path, plans, write = folder[0], [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **b))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert sum("MapInArrow" in x for x in plans) > 8
    assert [x for x in plans if python_workers(x) > 1] == []
