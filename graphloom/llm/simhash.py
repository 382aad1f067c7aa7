"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: A-Z is lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles are four
consecutive words, repeats included, joined by spaces (fewer words: the whole sequence). Each hashes
with XXH64, seed 42; a bit is set if it is set in more than half of the hashes. No words: zero.

Links: distinct fingerprints at ``RADIUS`` or fewer differing bits. They are dealt to tiles by
population counts (of the whole, or of 2, 4 or 8 parts once there are very many), each packed to one
row. Two texts within the radius have population counts whose differences sum to the radius at most,
so all other tile pairs are skipped; the rest are compared in full by exclusive-or and bit counts.
A tile pair returns a spanning forest of its links, not the links, so a group of n near copies costs
at most n rows. A task cuts its tile pairs' forests down to one again and writes it, as a worker that
takes the links up in the same task would be a second one in each, kept for good and as large as the
first. Components of the forests give the classes.

The number of compared pairs grows with the square of the number of distinct fingerprints, as the
method is exact; more parts lower the factor (0.6 for one, 0.13 for four, 0.01 for eight on random
fingerprints) as the input grows. Only histograms of population counts reach the driver.

Fingerprints and classes of very many members, which may hold a third of all rows, are broadcast when
they are joined to rows; there are at most ``HOT_SHARE`` of them.

Defined cases: a null or empty text has fingerprint zero and links like any other; equal texts and
repeated rows share a class; a very long text is hashed whole, a task holding one at a time beside its
batch; a null ``doc_id`` never names a class that has another id; an empty table gives no rows; other
columns are ignored, and kept by the stage, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import UPPER, content_hash, lookup, may_hold, quoted, release, slices, table, unused
from graphloom.operators.components import connected_components, cut_down, settle
from graphloom.session import materialise

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile; grows with the input so that there are about ``TILES`` of them, up to ``MAX_TILE_ROWS``.
TILE_ROWS, TILES, MAX_TILE_ROWS = 8_192, 512, 1 << 20
#: Parts whose population counts make a tile, by the number of fingerprints from which they are used.
PARTS = ((1, 0), (2, 8_000_000), (4, 64_000_000), (8, 1_000_000_000))
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Pairs compared at a time; their differences stay in a processor's cache.
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(SHINGLE_WORDS, len(words))
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _cell(parts: int) -> list[Column]:
    """Population counts of the parts of ``fp``."""
    bits = 64 // parts
    return [F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1 if parts > 1 else -1))).alias(f"c{k}") for k in range(parts)]


def _near_cells(parts: int, radius: int) -> list[list[int]]:
    """Offsets of population counts whose absolute values sum to ``radius`` at most, one of each pair of opposites."""
    near = (d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius) if parts <= 4 else _ball(parts, radius)
    return [list(d) for d in near if tuple(d) >= (0,) * parts]


def _ball(parts: int, radius: int) -> Iterator[tuple[int, ...]]:
    if not parts:
        yield ()
        return
    for first in range(-radius, radius + 1):
        for rest in _ball(parts - 1, radius - abs(first)):
            yield (first, *rest)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within ``a``, as (member, set's first member)."""
    both = a if b is None else np.concatenate([a, b])
    right, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(both))
    step = max(1, _CHUNK // max(1, len(right)))
    apart, bits = np.empty((step, len(right)), dtype=np.uint64), np.empty((step, len(right)), dtype=np.uint8)
    for k in range(0, len(a), step):
        from_ = k + 1 if b is None else 0
        at = np.s_[: min(step, len(a) - k), : len(right) - from_]
        np.bitwise_xor(a[k : k + step, None], right[None, from_:], out=apart[at])
        np.bitwise_count(apart[at], out=bits[at])
        if bits[at].min(initial=64) > radius:  # as in nearly all chunks
            continue
        i, j = np.nonzero(bits[at] <= radius)
        i, j = i + k, j + from_ + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            label = settle(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int | None = None, tile_rows: int | None = None) -> DataFrame:
    """(u, v): links between fingerprints (column fp, distinct) whose components are those of all links, as written."""
    n = distinct.count()
    parts = parts or max(p for p, least in PARTS if n >= least)
    tile_rows = tile_rows or min(MAX_TILE_ROWS, max(TILE_ROWS, n // TILES))
    cell = [f"c{k}" for k in range(parts)]
    counted = distinct.select("fp", *_cell(parts))
    subs = counted.groupBy(*cell).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("subs"))
    tiles = counted.join(subs, cell).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    packed = materialise(tiles.groupBy(*cell, "sub").agg(F.collect_list("fp").alias("fps")).withColumn("tile", F.concat_ws("-", *cell, "sub")), "simhash-tiles")

    offsets = F.array(*[F.array(*map(F.lit, d)) for d in _near_cells(parts, radius)])
    names = packed.select(*cell, "sub", "tile")
    reach = names.select(F.col("tile").alias("a"), F.col("sub").alias("sub_a"), *cell, F.explode(offsets).alias("d"))
    reach = reach.select("a", "sub_a", F.expr(" and ".join(f"d[{k}] = 0" for k in range(parts))).alias("own"), *[(F.col(c) + F.col("d")[k]).alias(c) for k, c in enumerate(cell)])
    pairs = reach.join(names.withColumnRenamed("tile", "b"), cell).where("not own or sub_a <= sub").select("a", "b")
    left = packed.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a"))
    right = packed.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b"))
    dealt = pairs.join(left, "a").select("b", F.when(F.col("a") != F.col("b"), F.col("fps_a")).alias("fps_a")).join(right, "b").select("fps_a", "fps_b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                b = b.values.to_numpy().view(np.uint64)
                u, v = forest(b, None, radius) if not a.is_valid else forest(a.values.to_numpy().view(np.uint64), b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut_down(compared(batches))
        release()

    return materialise(dealt.mapInArrow(compare, "u long, v long"), "simhash-links")


def _classes(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, int]:
    """(doc_id, fp, component, component_id) of every document, and their number."""
    found = materialise(fingerprints(docs), "simhash")
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    linked = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("id", "fp")
    members = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    total = found.count()
    classes = materialise(lookup(members, named, "component", "members", total).select("fp", "rows", "component", "component_id"), "simhash-classes")
    return lookup(found, classes, "fp", "rows", total).drop("rows"), total


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; fingerprint has 16 hexadecimal digits."""
    found, _ = _classes(docs, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def _one_a_class(rows: DataFrame, judged: DataFrame, total: int) -> DataFrame:
    """Of rows without id or that share ids, those whose class their own id names, or that have none: one an id and class.

    Equal rows are made one before anything is joined; of different rows of one id and class the first by its
    contents (as JSON) stays.
    """
    names = rows.columns
    fp, content, row = unused(names, "fp", "content", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], [*part.schema.names, fp])

    hashed = rows.withColumn(content, F.struct(content_hash(rows, 1).alias("a"), content_hash(rows, 2).alias("b")))
    single = hashed.groupBy(content).agg(F.first(F.struct(*quoted(rows))).alias(row)).select(*[F.col(f"{row}.`{n}`").alias(n) for n in names])
    marked = single.mapInArrow(run, T.StructType([*single.schema.fields, T.StructField(fp, T.LongType())]))
    classes = judged.groupBy(F.col("fp").alias(fp)).agg(*[F.first(c).alias(f"{content}{c}") for c in ("component", "component_id")], F.count("*").alias(f"{content}rows"))
    own = lookup(marked, classes, fp, f"{content}rows", total).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col(f"{content}component_id")))
    whole = F.struct(*quoted(rows))
    picked = own.groupBy(F.col("doc_id").alias(f"{content}id"), f"{content}component").agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return picked.select(*[F.col(f"{row}.`{n}`").alias(n) for n in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate class keep the document with the least id.

    A filter of the ids to drop, of bounded size, leaves rows that it surely does not hold where they lie; the others, the
    dropped ones and the filter's false alarms, are written apart and judged by an exact join.

    Rows that repeat an id are told apart by class: a row stays if its id is its own class's least, one row an id and
    class. No class can name a row without an id: of such rows one a class stays.
    """
    judged, total = _classes(docs)
    per_id = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("least"))
    per_id = materialise(per_id.where("rows > 1 or not least"), "simhash-dropped")
    known, several = per_id.agg(F.count("*"), F.count_if("least")).first()
    maybe, key, rows, least = unused(docs.columns, "maybe", "key", "rows", "least")
    flagged = may_hold(docs, F.col("doc_id").cast("long"), per_id, "doc_id", known, maybe)
    kept = flagged.where(F.col("doc_id").isNotNull() & ~F.col(maybe)).select(*quoted(docs))
    doubtful = materialise(flagged.where(F.col("doc_id").isNotNull() & F.col(maybe)).select(*quoted(docs), F.col("doc_id").cast("long").alias(key)), "simhash-doubtful")
    found = lookup(doubtful, per_id.toDF(key, rows, least), key, rows, total, "left")
    kept = kept.union(found.where(F.col(least).isNull()).select(*quoted(docs)))
    again = docs.where("doc_id is null")
    if several:
        again = again.union(found.where(least).select(*quoted(docs)))
    elif again.select("doc_id").isEmpty():
        return kept
    return kept.union(_one_a_class(again, judged, total))
