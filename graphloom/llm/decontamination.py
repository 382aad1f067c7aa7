"""Benchmark decontamination by a prefix-filtered set join with exact containment.

A-Z is lower-cased; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is
``WINDOW_WORDS`` consecutive item words, or the whole item if it has fewer. A document word is hit
if it lies inside an occurrence of any window.

A window occurs only if all its shingles (``SHINGLE_WORDS`` words) do, so its set overlap must be
complete and its necessary prefix is one shingle: the rarest by its count over all documents. Two
passes read the documents. The first counts the benchmark's shingles; documents reduce to counts
of those alone. The second probes every document shingle against the rarest ones, applies the
length and positional bounds (the window must start at word 0 or later and end by the last word),
and compares the window word by word.

The benchmark's index is sent to the executors in blocks of ``BLOCK_WORDS`` item words (a longer item
is a block of its own), one block at a time, so what is broadcast and what a worker holds has a fixed
bound. Each block takes two passes over the documents; with more than one, the hits of each text are
written as bit sets and united by a hash of the text. Documents are read, never shuffled with their
texts.

Defined cases: a null text has no words and is clean; an item without words has no window; equal
items and repeated rows each count; a null ``item_id`` marks hits but is not listed; an empty
benchmark leaves all documents clean; a very long text is judged whole, a task holding one at a time
beside its batch; an empty table gives no rows; columns other than ids and texts are ignored, and kept
by the stage, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lookup, slices, table
from graphloom.session import materialise

WINDOW_WORDS, SHINGLE_WORDS, BLOCK_WORDS = 13, 4, 1_000_000
#: A document is contaminated if one word in so many is hit.
HIT_SHARE = 20
#: Of UTF-8 bytes: A-Z in lower case, digits, a-z and bytes of other characters as they are, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit mix of each ``width`` consecutive word numbers."""
    n = len(ids) - width + 1
    mixed = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        mixed = (mixed + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass
class Index:
    """The windows of a block of items, by word numbers.

    ``words`` has the numbers of all item words in a row. A window is a place there (``starts``) and a length (``sizes``);
    equal windows are one. ``owners[owner_starts[k]:owner_starts[k + 1]]`` are the items, places in ``names``, of window k.
    ``by_width`` has for each shingle width the sorted mixes of prefix shingles; position k there belongs to
    ``entries[start[k]:start[k + 1]]``, rows of (window, offset of the shingle in it).
    """

    vocabulary: dict[bytes, int]
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    names: list[str]
    owner_starts: np.ndarray
    owners: np.ndarray
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; -1 for words that no item has."""
        own = words(text)
        return np.fromiter(map(self.vocabulary.get, own, repeat(-1)), dtype=np.int64, count=len(own))

    def window(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k] + self.sizes[k]]

    def probes(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and mixes of the shingles of ``ids`` whose words are all the benchmark's."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        known = ids >= 0
        whole = known[:n].copy()
        for k in range(1, width):
            whole &= known[k : k + n]
        at = np.flatnonzero(whole)
        return at, _shingles(ids, width)[at]


def _distinct(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each window the number of the first that is equal to it."""
    first = np.arange(len(starts))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        _, lead, same = np.unique(_shingles(numbers, size)[starts[own]], return_index=True, return_inverse=True)
        other = own[lead[same]]
        equal = np.ones(len(own), dtype=bool)
        for k in range(size):  # windows that share a hash alone stay apart
            equal &= numbers[starts[own] + k] == numbers[starts[other] + k]
        first[own[equal]] = other[equal]
    return first


def build(items: list[tuple[str | None, str | None]]) -> Index:
    """Windows of a block of items (item_id as text, text), not yet by prefix shingle."""
    vocabulary: dict[bytes, int] = {}
    held = [[vocabulary.setdefault(w, len(vocabulary)) for w in words(text)] for _, text in items]
    lengths = np.array([len(x) for x in held], dtype=np.int64)
    numbers = np.fromiter((n for x in held for n in x), dtype=np.int64, count=int(lengths.sum()))
    item = np.repeat(np.arange(len(items)), lengths)
    size = np.minimum(WINDOW_WORDS, lengths)[item]
    starts = np.flatnonzero(np.arange(len(numbers)) + size <= np.cumsum(lengths)[item])
    first = _distinct(numbers, starts, size[starts])
    kept, window = np.unique(first, return_inverse=True)
    named = np.array([name is not None for name, _ in items], dtype=bool)[item[starts]] if len(items) else np.zeros(0, dtype=bool)
    pairs = np.unique(np.stack([window[named], item[starts][named]], axis=1), axis=0)
    owner_starts = np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))
    return Index(vocabulary, numbers, starts[kept], size[starts][kept], [name or "" for name, _ in items], owner_starts, pairs[:, 1])


def order_by_rarity(index: Index, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Choose each window's prefix shingle: the one with the least count, of equals the first. counts: by width, sorted mixes and their numbers."""
    widths = np.minimum(SHINGLE_WORDS, index.sizes)
    for width in np.unique(widths).tolist():
        mixes = _shingles(index.words, width)
        keys, n = counts.get(width, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
        count = np.zeros(len(mixes), dtype=np.int64)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, mixes), len(keys) - 1)
            count = np.where(keys[place] == mixes, n[place], 0)
        chosen, offset = np.flatnonzero(widths == width), np.zeros(len(index.starts), dtype=np.int64)
        for size in np.unique(index.sizes[chosen]).tolist():
            own = chosen[index.sizes[chosen] == size]
            offset[own] = np.argmin(np.stack([count[index.starts[own] + k] for k in range(size - width + 1)], axis=1), axis=1)
        mix = mixes[index.starts[chosen] + offset[chosen]]
        order = np.argsort(mix, kind="stable")
        found, start = np.unique(mix[order], return_index=True)
        index.by_width[width] = (found, np.append(start, len(mix)), np.stack([chosen[order], offset[chosen][order]], axis=1))


def mark(index: Index, text: str | None) -> tuple[np.ndarray, set[str]]:
    """Which words of a text are hit, and the items that have an occurring window."""
    ids = index.numbers(text)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    hit: set[int] = set()
    for width, (keys, start, entries) in index.by_width.items():
        at, mixes = index.probes(ids, width)
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(keys, mixes), len(keys) - 1)
        same = keys[place] == mixes
        for position, k in zip(at[same].tolist(), place[same].tolist(), strict=True):
            for number, offset in entries[start[k] : start[k + 1]].tolist():
                window, first = index.window(number), position - offset
                if first < 0 or first + len(window) > len(ids) or not np.array_equal(ids[first : first + len(window)], window):
                    continue
                edge[first] += 1
                edge[first + len(window)] -= 1
                hit.update(index.owners[index.owner_starts[number] : index.owner_starts[number + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, {index.names[k] for k in hit}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of about ``BLOCK_WORDS`` words, one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        own = len(words(row[1]))
        if block and size + own > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += own
    yield block


def _rarity(docs: DataFrame, index: Index) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of the block's windows occurs in all documents: by width, sorted mixes and their numbers."""
    wanted: dict[int, np.ndarray] = {}
    for size in np.unique(index.sizes).tolist():
        width, own = min(SHINGLE_WORDS, size), index.starts[index.sizes == size]
        mixes = _shingles(index.words, width)
        held = [mixes[own + k] for k in range(size - width + 1)] + ([wanted[width]] if width in wanted else [])
        wanted[width] = np.unique(np.concatenate(held))
    if not wanted:
        return {}
    none = np.zeros(0, dtype=np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast((Index(index.vocabulary, none, none, none, [], none, none), wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, keys = shipped.value
        total = {width: np.zeros(len(k), dtype=np.int64) for width, k in keys.items()}
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                ids = plain.numbers(text)
                for width, own in keys.items():
                    _, mixes = plain.probes(ids, width)
                    place = np.minimum(np.searchsorted(own, mixes), len(own) - 1)
                    total[width] += np.bincount(place[own[place] == mixes], minlength=len(own))
        for width, n in total.items():
            seen = np.flatnonzero(n)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), width, dtype=np.int32)), pa.array(keys[width][seen].view(np.int64)), pa.array(n[seen])], ["width", "mix", "n"])

    found = docs.select("text").mapInArrow(count, "width int, mix long, n long").groupBy("width", "mix").agg(F.sum("n").alias("n")).toArrow()
    shipped.unpersist()
    width, mix, n = (c.to_numpy() for c in found.columns)
    by_width = {}
    for w, keys in wanted.items():
        own, counted = mix[width == w].view(np.uint64), np.zeros(len(keys), dtype=np.int64)
        counted[np.searchsorted(keys, own)] = n[width == w]
        by_width[w] = keys, counted
    return by_width


def _result(ids: pa.Array, total: list[int], hit: list[int], items: list[set[str]]) -> pa.RecordBatch:
    listed = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    dirty = [h > 0 and HIT_SHARE * h >= n for n, h in zip(total, hit, strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(listed, pa.string()), pa.array(dirty, pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's blocks, ordered by rarity in ``docs``, as broadcasts, one at a time; and whether it is the last."""
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        index = build(block)
        order_by_rarity(index, _rarity(docs, index))
        shipped = docs.sparkSession.sparkContext.broadcast(index)
        yield shipped, following is None
        if following is not None:
            shipped.unpersist()
        block = following


def _hits(docs: DataFrame, shipped: Broadcast, everything: bool) -> DataFrame:
    """(doc_id, a, b, n_words, bits, items) of the documents that a block hits, or of all; a and b are hashes of the text."""
    names = ["doc_id", "a", "b", "n_words", "bits", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [mark(shipped.value, t) for t in part.column("text").to_pylist()]
            keep = pa.array([everything or bool(hit.any()) for hit, _ in found], pa.bool_())
            bits = pa.array([np.packbits(hit).tobytes() if hit.any() else None for hit, _ in found], pa.binary())
            own = [pa.array([len(hit) for hit, _ in found], pa.int64()), bits, pa.array([sorted(items) for _, items in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *own], names).filter(keep)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")
    return hashed.mapInArrow(run, "doc_id long, a long, b long, n_words long, bits binary, items array<string>")


def _united(base: DataFrame, others: list[DataFrame]) -> DataFrame:
    """The result from the hits of several blocks; base has a row for every document."""
    key = F.struct("a", "b").alias("key")
    each = [t.where("bits is not null").groupBy(key).agg(F.first("bits").alias("bits"), F.first("items").alias("items"), F.count("*").alias("rows")) for t in (base, *others)]
    merged = reduce(DataFrame.union, each).groupBy("key").agg(F.collect_list("bits").alias("bits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("rows").alias("rows"))
    merged = materialise(merged, "decontamination-hits")
    joined = lookup(base.select("doc_id", "n_words", key), merged, "key", "rows", base.count(), "left").select("doc_id", "n_words", "bits", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for bits in batch.column("bits").to_pylist():
                hit.append(int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in bits])).sum()) if bits else 0)
            yield _result(batch.column("doc_id"), batch.column("n_words").to_pylist(), hit, [set(x or ()) for x in batch.column("items").to_pylist()])

    return joined.mapInArrow(run, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held: list[DataFrame] = []
    for shipped, last in _indexes(docs, benchmark):
        if last and not held:
            return _judged(docs, shipped)
        held.append(materialise(_hits(docs, shipped, not held), "decontamination-block"))
    return _united(held[0], held[1:])


def _judged(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """The result from the only block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [mark(shipped.value, t) for t in part.column("text").to_pylist()]
            yield _result(part.column("doc_id"), [len(h) for h, _ in found], [int(h.sum()) for h, _ in found], [x for _, x in found])

    return docs.mapInArrow(run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any window of an item, each judged where it lies; nothing is shuffled.

    The share that makes ``contaminated`` does not count here: a passage is a leak in a text of any length. Between two
    blocks of the benchmark what is left is written.
    """

    def without(shipped: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                yield part.filter(pa.array([not mark(shipped.value, t)[0].any() for t in part.column("text").to_pylist()], pa.bool_()))

        return left.mapInArrow(run, left.schema)

    left = docs
    for shipped, last in _indexes(docs.select("text"), benchmark):
        left = without(shipped) if last else materialise(without(shipped), "decontamination-left")
    return left


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop every document that holds a window of a benchmark item, row by row."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i + 1, i + least(13, len(w))) AS gram
  FROM items, unnest(range(len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), grams AS (
  SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS gram
  FROM docs, (SELECT DISTINCT n FROM windows) AS k, unnest(range(greatest(len(w) - n + 1, 0))) AS t(i)
), found AS (
  SELECT doc_id, g.n, i, item_id FROM grams g JOIN windows v ON g.gram = v.gram
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
