"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts (``FEATURES``) are counts and shares, made more nearly normal by logarithms
and square roots. Each class has its own mean and covariance; a covariance is shrunk towards the
pooled one by ``POOLED`` and towards the identity (of standardised statistics) by ``RIDGE``, so it
has a Cholesky factor for any sample. A text's score is the logistic function of the difference of
the two Mahalanobis log densities and log priors, over the number of statistics; the factors'
inverses are computed once and kept with the model.

The statistics are computed once and written as a table. The classes' sums and products are added up
per partition and then as at most ``d * d`` numbers a class, from all labelled rows of the training
part; the driver gets those sums only.

Defined cases: a null text counts as the empty one, which is scored like any other; a very long text
is read whole, a task holding one at a time beside its batch; labels that are null or not 0 or 1 are
not learned; a document with several labels, or several documents of one id, count with each; equal
texts have equal scores; a score of 0.5 predicts 1; with fewer than two labelled documents of either
class every score is the share of label 1 among those learned (0.5 without any); a constant statistic
has no influence; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, slices, table
from graphloom.session import materialise

POOLED, RIDGE = 0.2, 0.05
FEATURES = (
    "log_words", "word_length", "upper", "digit", "sign", "shout", "bar", "stop", "distinct", "top_word", "top_sign_word",
    "same_neighbour", "neighbour_pairs", "line_repeats", "log_line", "sign_ends", "upper_words", "long_words",
)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGIT = b"0123456789"
_STOP = b".,;:?"
_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:?'\"-!|")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    chars = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))

    def share(signs: bytes) -> float:
        return (len(raw) - len(raw.translate(None, signs))) / chars

    counts = Counter(words)
    top = max(counts.values(), default=0)
    ends = Counter(w[-1] for w in words)
    signs = sum(c for ch, c in ends.items() if not ch.isalnum() and ch not in ".,;:?'\"")
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    upper_words = sum(map(str.isupper, words))
    long_words = sum(len(w) > 15 for w in words)
    return [
        np.log1p(len(words)), np.log1p(len(text) / n), np.sqrt(share(_UPPER)), np.sqrt(share(_DIGIT)), np.sqrt(share(_SIGN)),
        np.sqrt(share(b"!")), np.sqrt(share(b"|")), np.sqrt(share(_STOP)), len(counts) / n, np.sqrt(top / n),
        np.sqrt(max((c for w, c in counts.items() if not w.isalpha()), default=0) / n), np.sqrt(same / n), pairs / n,
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))), np.log1p(len(text) / max(1, len(lines))), np.sqrt(signs / n),
        np.sqrt(upper_words / n), np.sqrt(long_words / n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [[float(v) for v in statistics(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log terms of the two classes, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]
    constant: float | None = None

    @classmethod
    def fit(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
        """sums: of each class the number of rows, the sum of statistics and the sum of their products."""
        counts = [sums[k][0] if k in sums else 0 for k in (0, 1)]
        if min(counts) < 2:
            return cls(np.zeros(0), np.ones(0), [], [], [], counts[1] / sum(counts) if sum(counts) else 0.5)
        n = sum(counts)
        centre = sum(sums[k][1] for k in (0, 1)) / n
        spread = np.diag(sum(sums[k][2] for k in (0, 1))) / n - centre**2
        scale = np.sqrt(np.where(spread > 1e-12, spread, 1.0))
        means, covariances = [], []
        for k in (0, 1):
            mean = sums[k][1] / counts[k]
            means.append((mean - centre) / scale)
            covariances.append((sums[k][2] / counts[k] - np.outer(mean, mean)) / np.outer(scale, scale))
        shared = sum(c * x for c, x in zip(counts, covariances, strict=True)) / n
        factors, logs = [], []
        for k in (0, 1):
            shrunk = (1 - ridge) * ((1 - pooled) * covariances[k] + pooled * shared) + ridge * np.eye(len(centre))
            lower = np.linalg.cholesky((shrunk + shrunk.T) / 2)
            factors.append(np.linalg.inv(lower))
            logs.append(float(np.log(counts[k] / n) - np.log(np.diag(lower)).sum()))
        return cls(centre, scale, means, factors, logs)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score of each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        zero, one = (log - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True))
        return 0.5 * (1 + np.tanh(0.5 * (one - zero) / x.shape[1]))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on (x, quality)."""
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((d + 1, d + 1)) for k in (0, 1)}
        for batch in batches:
            x = _matrix(batch.column("x"))
            wide = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = wide[label == k]
                total[k] += own.T @ own
        for k, products in total.items():
            if products[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([k] * products.size, pa.int32()), pa.array(range(products.size), pa.int32()), pa.array(products.reshape(-1))], ["quality", "at", "v"])

    rows = labelled.select("x", "quality").mapInArrow(add, "quality int, at int, v double").groupBy("quality", "at").agg(F.sum("v").alias("v")).collect()
    sums: dict[int, np.ndarray] = {}
    for row in rows:
        sums.setdefault(row["quality"], np.zeros((d + 1) ** 2))[row["at"]] = row["v"]
    return Discriminant.fit({k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, v in sums.items() for m in [v.reshape(d + 1, d + 1)]})


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Whether a document is kept from the fit."""
    return crc_mod("doc_id", 3) == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = materialise(features(docs), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    model = fit(found.where(~held_out()).join(known, "doc_id"))
    return score(found, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of those not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
