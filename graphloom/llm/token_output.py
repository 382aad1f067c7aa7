"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

A data set is a Parquet folder of blocks. A block is self-contained: its ids are replaced by their
rank in the block's own frequency order (``ranks`` lists the ids, most frequent first), each rank
takes one to four little-endian bytes in ``data``, and ``control`` holds the lengths, two bits each,
four to a byte. Decoding looks the control bytes up in a 256-row table of lengths.

Documents are dealt to shards by ascending ``doc_id`` (null first), sorted within them, and packed
in blocks of about ``BLOCK_TOKENS`` ids; a longer document is a block of its own. The bounds of the
shards come from the id column alone, so no text is read or tokenised twice, and only token ids are
shuffled, by number of shard, so that the files, in the order of their names, have ascending ids. An
id with so many rows that it is the bound of several shards is spread over those by a hash of its
token ids; within a shard rows of one id are ordered by their token ids' bytes, so reruns agree.

Defined cases: a null or empty text has the end id alone; a very long text is encoded whole and is a
block of its own; rows that are equal in id and text lie together, of which a task holds one block at a
time; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import per_worker, release, slices, table
from graphloom.session import fresh_path

END_ID = 1
BLOCK_TOKENS = 1_000_000
SHARD_DOCS, MAX_SHARDS = 1_000, 16_384
CACHE_WORDS = 300_000
#: Stands for a missing id where shards are found.
_NONE = -(1 << 63)
BLOCK_SCHEMA = "shard int, block int, n_tokens long, doc_ids binary, null_ids int, counts binary, ranks binary, control binary, data binary"
DOC_SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, shard int, block int, before long"
#: Runs of ASCII signs, or of other characters but white space.
_PIECE = re.compile(rb"[!-/:-@\[-`{-~]+|[^\s!-/:-@\[-`{-~]+")
#: Bytes of texts that may be split into such runs: ASCII without the apostrophe, and the letters of U+00C0 to U+00FF.
_PLAIN = bytes(c for c in b"\t\n\r\xc3" + bytes([*range(32, 127), *range(0x80, 0xC0)]) if c != ord("'"))
#: Bytes of words in lower case: a-z and the letters of U+00DF to U+00FF.
_LETTERS = bytes([*range(ord("a"), ord("z") + 1), 0xC3, *(c for c in range(0x9F, 0xC0) if c != 0xB7)])
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {c: chr(256 + k) for k, c in enumerate(sorted({*range(256)} - {*_SHOWN}))}
#: Bytes of each of the four codes of a control byte.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Packed ids of white-space-free pieces, in two generations of at most ``CACHE_WORDS``.

    An unknown piece is encoded and kept. When the young generation is full it becomes the old one;
    pieces that are met again become young again, the rest goes with the next change.
    """

    def __init__(self, tokenizer, dtype: np.dtype):
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.old: dict[bytes, bytes] = {}
        self.code = "H" if dtype.itemsize == 2 else "I"

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.old.pop(piece, None) or self._encoded(piece)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def _encoded(self, piece: bytes) -> bytes:
        if not piece.translate(None, _LETTERS):  # a single word that neither normaliser nor splitter changes
            word = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_BYTE_CHARS)
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array(self.code, ids).tobytes()


class Encoder:
    """Encodes whole texts with a ``tokenizers`` file by way of remembered pieces.

    The vocabulary lower-cases, drops white space and never merges across white space or between
    letters and other signs, so a text's ids are its pieces' ids in order. Where that is certain
    (ASCII but the apostrophe, letters up to U+00FF) the text is lower-cased and pieces are runs of
    signs or of the rest; other texts are split at white space alone; texts with an added token's
    string are encoded in one go.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(tokenizer, self.dtype)

    def encode(self, text: str) -> bytes:
        """The text's ids and the end id as packed little-endian integers."""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes() + self.end
        raw = text.encode("utf-8", "replace")
        if raw.translate(None, _PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
            own = raw.split()
        else:
            own = _PIECE.findall(text.lower().encode())
        return b"".join(map(self.pieces.__getitem__, own)) + self.end


def encode_ranks(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of a block of ids."""
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    order = present[np.argsort(-counts[present], kind="stable")]
    kind = np.uint16 if len(order) <= 1 << 16 else np.uint32
    rank_of = np.zeros(len(counts), dtype=kind)
    rank_of[order] = np.arange(len(order), dtype=kind)
    coded = rank_of[ids]
    extra = (coded > 0xFF).view(np.uint8)
    if kind is np.uint32:
        extra = extra + (coded > 0xFFFF) + (coded > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    padded[: len(ids)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    starts = np.arange(len(ids), dtype=np.int64)
    starts[1:] += np.cumsum(extra[:-1], dtype=np.int64)
    data = np.empty(len(ids) + int(extra.sum(dtype=np.int64)), dtype=np.uint8)
    data[starts] = coded.astype(np.uint8)
    for k in range(1, coded.itemsize):
        longer = np.flatnonzero(extra >= k)
        data[starts[longer] + k] = (coded[longer] >> kind(8 * k)).astype(np.uint8)
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ranks(n: int, ranks: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids of a block, as little-endian unsigned 32-bit integers."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.zeros(n, dtype=np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    held = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    coded = held[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        coded[longer] |= held[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranks, dtype="<u4")[coded]


def _bounds(docs: DataFrame) -> np.ndarray:
    """Upper bounds of all shards but the last, one repeated for an id that fills several; their number is limited by ``MAX_SHARDS``."""
    n, none = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    shards = max(1, min(MAX_SHARDS, n // SHARD_DOCS))
    if shards == 1:
        return np.zeros(0, dtype=np.int64)
    # nulls are counted apart, as percentiles leave them out
    alone = min(shards - 1, round(none * shards / n))
    cuts = [k / (shards - alone) for k in range(1, shards - alone)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * shards)).alias("b")).first()["b"] if cuts else None
    return np.array([_NONE] * alone + (found or []), dtype=np.int64)


def _shards(ids: np.ndarray, packed: list[bytes], bounds: np.ndarray) -> np.ndarray:
    """The shard of each document, from its id and its token ids."""
    low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, "right")
    for k in np.flatnonzero(high - low > 1).tolist():
        low[k] += zlib.crc32(packed[k]) % (high[k] - low[k])
    return low


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks below ``path``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(docs)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("tokens", tokenizer, end_id), lambda: Encoder(tokenizer, end_id))
        for part in slices(batches, "text"):
            ids = part.column("doc_id")
            packed = [encoder.encode(text) for text in part.column("text").to_pylist()]
            shard = _shards(pc.fill_null(ids, _NONE).to_numpy(zero_copy_only=False), packed, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard.astype(np.int32)), pa.array([encoder.dtype.itemsize] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "shard", "width", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        shard, block, size = -1, 0, 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            ranks, control, data = encode_ranks(ids)
            keys = np.array([x[0] or 0 for x in held], dtype="<i8").tobytes()
            counts = np.array([len(x[1]) for x in held], dtype="<i8").tobytes()
            row = {"shard": shard, "block": block, "n_tokens": len(ids), "doc_ids": keys, "null_ids": sum(x[0] is None for x in held), "counts": counts, "ranks": ranks, "control": control, "data": data}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for key, own, width, raw in zip(*(batch.column(c) for c in range(4)), strict=True):
                own, ids = own.as_py(), np.frombuffer(raw.as_buffer(), dtype=f"<u{width.as_py()}")
                if held and (own != shard or size + len(ids) > BLOCK_TOKENS):
                    yield packed()
                    block, size, held = (block + 1 if own == shard else 0), 0, []
                shard = own
                held.append((key.as_py(), ids.copy()))
                size += len(ids)
        if held:
            yield packed()
        held = []
        release()

    shards = len(bounds) + 1
    files = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        docs.mapInArrow(tokenised, "doc_id long, shard int, width int, ids binary")
        .repartitionById(files, F.floor(F.col("shard").cast("long") * files / shards).cast("int"))
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens and the crc32 of its decoded ids."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                ids = decode_ranks(row["n_tokens"], row["ranks"], row["control"], row["data"])
                counts = np.frombuffer(row["counts"], dtype="<i8")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
                keys = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=np.arange(len(counts)) < row["null_ids"])
                same = [np.full(len(counts), row[c], dtype=np.int32) for c in ("shard", "block")]
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts), pa.array(crc, pa.int64()), *map(pa.array, same), pa.array(ends - counts)], ["doc_id", "n_tokens", "ids_crc32", "shard", "block", "before"])
        release()

    sizes = stored.select("shard", "block", "n_tokens")
    total = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("t")).select("shard", F.coalesce(F.sum("t").over(total), F.lit(0)).alias("shard_start"))
    starts = sizes.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("block_start"))
    docs = stored.mapInArrow(documents, DOC_SCHEMA)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token blocks and read back."""
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: write the documents' token ids and return what the files hold."""
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path())
    return read_tokens(spark, path)
