"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a row of language bits at every position: the rows at an n-gram's
positions, combined by AND, give all languages that contain the n-gram at once. A text's n-grams are
looked up, bits are counted per language, and the counts are corrected for false positives: with a
share c of a text's n-grams found for a language whose slice answers yes by chance at rate f, the
share that it really contains is (c - f) / (1 - f). The language with the largest share wins.

N-grams are ``GRAM`` characters of the lower-cased text in which each run of other signs than letters
and their combining marks (Unicode categories L and M) is one space. A language contains an n-gram if
at least ``MIN_SHARE`` of its sample's n-grams are that one and at least ``OWN_SHARE`` of the n-gram's
shares of all languages are its own, which keeps out what foreign passages brought in. The filter is
fitted on at most ``TRAIN_DOCS`` labelled documents a language, chosen by a hash of the id, and on all
n-grams of their whole texts. All that a language contains enter it, and its size follows their
number, which cannot exceed 1 / ``MIN_SHARE`` a language.

A text is in no learned language if the winner's share is below ``REJECT_BELOW``. Fewer than
``ENOUGH_GRAMS`` n-grams do not show that, as the filter holds a bounded sample's common n-grams
alone: such a text must also have no letter of a script that the sample has.

Defined cases: a null text or one without letters (number signs and lone marks are none) is ``und``
with score 0; a text none of whose n-grams is known gets the most frequent label with score 0; ties go
to the more frequent label, then to the first in code-point order; without labelled documents every
text is ``und``; null labels are not learned; a very long text is judged whole, a task holding one
text at a time beside its batch; repeated rows count repeatedly; an empty table gives no rows; other
columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import crc_mod, slices, table
from graphloom.session import materialise

UNKNOWN = "und"
LANG, SCORE, FOREIGN = "__predicted_lang", "__predicted_score", "__predicted_foreign"
GRAM, HASHES, BITS_PER_GRAM = 4, 3, 16
TRAIN_DOCS, MIN_SHARE, OWN_SHARE = 1_500, 2e-6, 0.1
#: Ids of the sample are broadcast if there are at most so many, else joined by shuffling.
BROADCAST_ROWS = 200_000
#: The pipeline drops a text if less than this share of its n-grams is the winner's; with fewer n-grams than enough, only if its script is foreign too.
REJECT_BELOW, ENOUGH_GRAMS = 0.2, 50
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray | None:
    """A 64-bit number for each n-gram of a text; None if it has no letters."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, plain)):
        return None
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = max(1, len(codes) - GRAM + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(GRAM, len(codes))):
        mixed = mixed * np.uint64(0x110003) + codes[k : k + n]
    mixed *= _MIX
    return mixed ^ mixed >> np.uint64(32)


def scripts(letters: Iterable[str]) -> set[str]:
    """Scripts of the letters: the first words of their names."""
    return {unicodedata.name(c, "").partition(" ")[0] for c in set(letters) if c.isalpha()} - {""}


@dataclass
class BitSlicedBloom:
    """``rows[word, position]`` holds 64 languages' bits; ``chance[l]`` is the rate of false positives of language l; ``scripts`` are those of all languages."""

    labels: list[str]
    rows: np.ndarray
    chance: np.ndarray
    scripts: frozenset[str] = frozenset()

    @classmethod
    def build(cls, own: list[tuple[str, np.ndarray]], seen: Iterable[str] = ()) -> BitSlicedBloom:
        """own: each language's label with its n-grams, the more frequent label first. seen: scripts of the sample."""
        most = max([len(g) for _, g in own], default=1)
        size = 1 << max(10, int(most * BITS_PER_GRAM - 1).bit_length())
        rows = np.zeros((max(1, -(-len(own) // 64)), size), dtype=np.uint64)
        chance = np.zeros(len(own))
        for k, (_, own_grams) in enumerate(own):
            bit = np.uint64(1) << np.uint64(k % 64)
            for at in _positions(own_grams, size):
                np.bitwise_or.at(rows[k // 64], at, bit)
            chance[k] = (np.count_nonzero(rows[k // 64] & bit) / size) ** HASHES
        return cls([label for label, _ in own], rows, chance, frozenset(seen))

    def lookup(self, numbers: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as rows of 64-bit masks."""
        masks = None
        for at in _positions(numbers, self.rows.shape[1]):
            found = self.rows[:, at]
            masks = found if masks is None else masks & found
        return masks

    def shares(self, numbers: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language contains, corrected for false positives."""
        masks = self.lookup(numbers)
        raw = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(self.labels))]) / len(numbers)
        return np.maximum(0.0, (raw - self.chance) / (1 - self.chance))

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(label, score, foreign): score is the winner's share over the sum of all languages' shares, foreign whether the text is in no learned language."""
        numbers = grams(text)
        if numbers is None or not self.labels:
            return UNKNOWN, 0.0, True
        shares = self.shares(numbers)
        best = int(np.argmax(shares))
        total = float(shares.sum())
        foreign = bool(shares[best] < REJECT_BELOW) and (len(numbers) >= ENOUGH_GRAMS or self.scripts.isdisjoint(scripts(text)))
        return self.labels[best], float(shares[best] / total) if total else 0.0, foreign


def _positions(numbers: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = numbers >> np.uint64(40) | np.uint64(1)
    for k in range(HASHES):
        yield ((numbers + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def _sample(labelled: DataFrame, train_docs: int, languages: int, frequency: DataFrame) -> DataFrame:
    """(lang, text) of at most ``train_docs`` documents a language; only hashes are ranked and shuffled.

    Documents are known by a hash of the id, or of the text where there is none. A hash with many rows comes after the
    others and is left out if its rows do not fit, so that no id or copied text, however frequent, breaks the bound.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    keyed = labelled.select("lang", "text", key.alias("key"))
    # hashes below the share wanted, with a margin, go on to the exact ranks
    reach = frequency.select(F.col("lang").alias("l"), (train_docs * 1.5 + 200) / F.col("count")).toDF("l", "reach")
    near = keyed.select("lang", "key").join(F.broadcast(reach) if languages <= BROADCAST_ROWS else reach, F.col("lang") == F.col("l"))
    near = near.where(F.pmod("key", F.lit(1 << 30)) < F.col("reach") * (1 << 30)).groupBy("lang", "key").agg(F.count("*").alias("n")).where(F.col("n") <= train_docs)
    order = W.partitionBy("lang").orderBy(F.col("n") > 10, F.pmod("key", F.lit(1 << 30)), "key").rowsBetween(W.unboundedPreceding, 0)
    chosen = near.withColumn("held", F.sum("n").over(order)).where(F.col("held") <= train_docs).select(F.col("key").alias("k"), F.col("lang").alias("l"))
    if languages * train_docs <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return keyed.join(chosen, (F.col("key") == F.col("k")) & (F.col("lang") == F.col("l")), "left_semi").select("lang", "text")


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> BitSlicedBloom:
    """Fit the filter on (doc_id, text, lang). The driver gets the sample's scripts and 1 / ``MIN_SHARE`` numbers a language at most."""
    names = ["lang", "script", "gram", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            by_label: dict[str, list[np.ndarray]] = {}
            letters: set[str] = set()
            for label, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                numbers = grams(text)
                if numbers is not None:
                    by_label.setdefault(label, []).append(numbers)
                    letters.update(text)
            for label, own in by_label.items():
                numbers, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.string()), pa.nulls(len(n), pa.string()), pa.array(numbers.view(np.int64)), pa.array(n, pa.int64())], names)
            if seen := sorted(scripts(letters)):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.array(seen), pa.nulls(len(seen), pa.int64()), pa.array([1] * len(seen), pa.int64())], names)

    labelled = labelled.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    per = materialise(labelled.groupBy("lang").count(), "lang-frequency")
    frequency = dict(per.collect())
    sample = _sample(labelled, train_docs, len(frequency), per).mapInArrow(count, "lang string, script string, gram long, n long")
    # a row has a language's n-gram or, without a language, a script
    tallied = materialise(sample.groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    seen = [r[0] for r in tallied.where("script is not null").select("script").collect()]
    counted = tallied.where("script is null").select("lang", "gram", "n")
    totals = counted.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("total"))
    if len(frequency) <= BROADCAST_ROWS:  # one row a label
        totals = F.broadcast(totals)
    shared = counted.join(totals, F.col("lang") == F.col("l")).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= MIN_SHARE)
    held = shared.withColumn("own", F.col("share") / F.sum("share").over(W.partitionBy("gram"))).where(F.col("own") >= OWN_SHARE)
    found: dict[str, list[int]] = {label: [] for label in frequency}
    for row in held.select("lang", "gram").toLocalIterator():
        found[row["lang"]].append(row["gram"])
    labels = sorted(frequency, key=lambda x: (-frequency[x], x))
    return BitSlicedBloom.build([(x, np.array(found[x], dtype=np.int64).view(np.uint64)) for x in labels], seen)


def predict(docs: DataFrame, model: BitSlicedBloom) -> DataFrame:
    """``docs``' own columns with the label, the score and whether the text is in no learned language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shipped.value.decide(t) for t in part.column("text").to_pylist()]
            extra = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*names, LANG, SCORE, FOREIGN])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(LANG, T.StringType()), T.StructField(SCORE, T.DoubleType()), T.StructField(FOREIGN, T.BooleanType())]))


def held_out() -> Column:
    """Whether a document is kept from the fit."""
    return crc_mod("doc_id", 4) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col(LANG).alias("lang_pred"), F.col(SCORE).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop texts in no learned language, those whose n-grams, if enough, the winner hardly contains."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).where(~F.col(FOREIGN)).select(*docs.columns)
