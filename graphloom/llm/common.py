"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it has more than one in so many rows; so at most so many keys are.
HOT_SHARE = 1_000
#: 64-bit words of a key filter at most: 8 MB of bits.
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Give freed memory back to the system at the end of a task, as its worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_chars`` bytes of a text column, at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > max_chars:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("graphloom_worker_objects", ModuleType("graphloom_worker_objects")).__dict__.setdefault("objects", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front so that none is a column's, in any case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def content_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of a row's contents; maps, which have no order, count as JSON."""
    parts = [F.to_json(F.struct(c)) if isinstance(f.dataType, T.MapType) else c for c, f in zip(quoted(df), df.schema.fields, strict=True)]
    return F.xxhash64(F.lit(seed), *parts)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``right``, whose ``key`` is unique, to ``left``, whose keys may be hot.

    ``rows`` of ``right`` is the number of rows that ``left`` has of a key, ``total`` that of all. Keys with more than one
    in ``HOT_SHARE`` rows are at most ``HOT_SHARE`` and are broadcast, so that their rows stay where they lie; only the
    others are shuffled. ``how`` is inner or left.
    """
    hot = F.broadcast(right.where(F.col(rows) > total / HOT_SHARE))
    cold = right.where(F.col(rows) <= total / HOT_SHARE)
    spread = left.join(hot, key)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return spread.union(rest)


def _slot(key: Column, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(words - 1))


def _mask(key: Column) -> Column:
    """Three of 64 bits, from the part of the hash above the slot."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (24, 36, 48)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def may_hold(df: DataFrame, key: Column, held: DataFrame, held_key: str, count: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: false where ``key`` is surely none of the ``count`` values in ``held``; nothing is shuffled.

    A Bloom filter of one 64-bit word a slot, three bits a key. It has about a word a key, up to ``FILTER_WORDS``, which
    bounds what is broadcast whatever the number of keys; beyond that the share of false alarms grows (0.1 % at one key
    a word, 6 % at ten, 75 % at fifty). Keys are not null.
    """
    words = min(FILTER_WORDS, 1 << max(4, count - 1).bit_length())
    slot, mask = unused([*df.columns, flag], "slot", "mask")
    made = held.select(_slot(F.col(held_key), words).alias(slot), _mask(F.col(held_key)).alias(mask)).groupBy(slot).agg(F.bit_or(mask).alias(mask))
    joined = df.join(F.broadcast(made), _slot(key, words) == F.col(slot), "left")
    found = F.coalesce(F.col(mask).bitwiseAND(_mask(key)) == _mask(key), F.lit(False))
    return joined.select(*quoted(df), found.alias(flag))


def running_sums(df: DataFrame, order: list[Column], amounts: list[str], name: str, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums of ``amounts`` ahead of each row in a global order, in two levels.

    Rows are range-sorted by ``order``, of which ``group``, if any, must be the first; each range is summed as it streams
    by, so a group or a key of any size is spread over ranges. Returns the written rows with ``part`` and, for each
    amount, the sum ``inside`` of the rows ahead in the same part and group; and a small table of (group, part), the sum
    ``ahead`` of the parts before and the part's ``own``. Names: ``<amount>_inside``, ``_ahead``, ``_own``.
    """
    fields = [T.StructField("part", T.IntegerType()), *[T.StructField(f"{a}_inside", T.LongType()) for a in amounts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, sums = TaskContext.get().partitionId(), None, [0] * len(amounts)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in amounts]
            if group is None:
                cuts = [0, batch.num_rows]
            else:
                keys = batch.column(group)
                apart = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)), False).to_numpy(zero_copy_only=False)
                apart = apart | np.diff(keys.is_null().to_numpy(zero_copy_only=False))
                cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), batch.num_rows]
            made = [np.empty(batch.num_rows, dtype=np.int64) for _ in amounts]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = None if group is None else (batch.column(group)[a].as_py(),)
                if own != current:
                    current, sums = own, [0] * len(amounts)
                for k, value in enumerate(values):
                    total = np.cumsum(value[a:b])
                    made[k][a:b] = sums[k] + total - value[a:b]
                    sums[k] += int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), *map(pa.array, made)], [*batch.schema.names, "part", *[f"{a}_inside" for a in amounts]])

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = materialise(ordered.mapInArrow(run, T.StructType([*df.schema.fields, *fields])), name)
    return summed, sums_ahead(summed, amounts, group)


def sums_ahead(summed: DataFrame, amounts: list[str], group: str | None = None) -> DataFrame:
    """The second table of ``running_sums``, from its first."""
    by = [group] if group else []
    parts = summed.groupBy(*by, "part").agg(*[F.sum(a).alias(f"{a}_own") for a in amounts])
    before = (W.partitionBy(*by) if by else W).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"{a}_own").over(before), F.lit(0)).cast("long").alias(f"{a}_ahead") for a in amounts]
    return parts.select(*by, "part", *ahead, *[f"{a}_own" for a in amounts])
