"""Mixing sources to target weights by weighted fair queueing.

Size: the number of runs of ``[^\\x20\\x09-\\x0D]`` in a text. Sources in code-point order, null last,
weigh 5, 2, 1, repeating, and share the total of all sizes; a target stops at ``MAX_REPEAT`` times
its source's size and the excess is reshared by weight until none is above. That fixed point is
found in closed form: sources are capped in the order of cap over weight, as long as the level that
the rest would get lies above.

Every document is shuffled by md5 of seed and id within its source and may repeat up to three times.
A copy is queued in packets of ``PACKET`` words. A packet's virtual finish time is the number of its
source's words up to its end, over the source's target. All packets are sorted globally by virtual
finish time, their words are summed in that order, and the mix ends where the budget, the total of
all sizes, is used up; the packet that crosses the end gives its first words. In virtual time all
sources advance together, so each is within about a packet of its target there. The packets taken of
a copy are its first words.

Both running sums, of a source's words and of the mix, go over rows sorted by range (see
``running_sums``): the order includes a row number, so a source, an id or a row that repeats without
end is spread over ranges. A histogram of virtual time, of at most ``TIME_BINS`` rows, tells which
packets lie beyond the end; they are not sorted.

Defined cases: a null or empty text has size 0 and is taken for 0 words; a null source is a source
of its own; repeated rows are documents of their own, equal ones in an arbitrary order, which makes no
difference; a very long text is one row of its words' number, and of the mix as many packets as it
needs; packets that finish at the same time go by source, place in the source and copy; a source
without words has target 0; an empty table gives no rows; other columns are ignored, and kept by the
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import content_hash, lookup, quoted, running_sums, table, unused
from graphloom.session import materialise

WEIGHTS, MAX_REPEAT, SEED = (5, 2, 1), 3, "mix"
#: Words that are queued together; TIME_BINS / TIME_SCALE is the virtual time from which packets are counted together.
PACKET, TIME_SCALE, TIME_BINS = 128, 1_024, 4_096
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, *own: str) -> DataFrame:
    """(doc_id, source, size, key, row) of every document, and its columns ``own``; row is a number of its own."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *own)


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source, null as itself."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    weighed = per.select("source", "source_size", weight.cast("long").alias("weight"), (MAX_REPEAT * F.col("source_size")).alias("cap"))
    by_cap = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.asc_nulls_last("source"))
    before, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.select("*", left_size.alias("left_size"), left_weight.alias("left_weight"), F.row_number().over(by_cap).alias("place"))
    # the level is that of the first source, in cap order, that its own level does not fill
    free = F.col("left_size").cast("double") / F.col("left_weight") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(free, F.struct("place", F.col("left_size").cast("double").alias("s"), F.col("left_weight").alias("w")))).over(everything)
    share = F.col("weight") * level["s"] / level["w"]
    return levelled.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), share), F.col("cap").cast("double")).alias("target"))


def queue(docs: DataFrame, *own: str) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, before): before counts its source's words ahead of a document.

    own: columns that tell rows of one id apart; they are kept and order such rows.
    """
    sized = materialise(sizes(docs, *own), "mix-sizes")
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("size"), *map(F.asc, own), F.asc("row")]
    placed, ahead = running_sums(sized, order, ["size"], "mix-queue", group="source")
    goals = targets(sized).withColumnRenamed("source", "s")
    # a row for each source in each range: no key here is hot
    ahead = ahead.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "size_ahead", "source_size", "target")
    joined = placed.join(ahead, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "row", "size", "source_size", "target", (F.col("size_ahead") + F.col("size_inside")).alias("before"), *own)


def packets(queued: DataFrame) -> DataFrame:
    """(source, row, before, copy, piece, words, finish): all packets of all copies."""
    pieces = F.ceil(F.col("size") / PACKET).cast("int")
    wanted = queued.where("target > 0 and size > 0").select("*", F.explode(F.sequence(F.lit(0), pieces * MAX_REPEAT - 1)).alias("k"))
    wanted = wanted.select("*", F.floor(F.col("k") / pieces).cast("int").alias("copy"), F.pmod("k", pieces).alias("piece"))
    start = F.col("piece").cast("long") * PACKET
    words = F.least(F.lit(PACKET).cast("long"), F.col("size") - start)
    finish = (F.col("before") + F.col("copy") * F.col("source_size") + start + words) / F.col("target")
    return wanted.select("source", "row", "before", "copy", "piece", words.alias("words"), finish.alias("finish"))


def mix(queued: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, row, before, copy, piece, words, finish, at): the packets taken; at is their place in the mix, in words.

    budget: words in all, by default the total of all sizes, which is what it stops at.
    """
    total = queued.agg(F.sum("size")).first()[0] or 0
    budget = total if budget is None else min(budget, total)
    binned = packets(queued).withColumn("bin", F.least(F.floor(F.col("finish") * TIME_SCALE), F.lit(TIME_BINS)).cast("int"))
    end, seen = TIME_BINS, 0
    for row in binned.groupBy("bin").agg(F.sum("words").alias("n")).orderBy("bin").collect():
        seen += row["n"]
        if seen >= budget:
            end = row["bin"]
            break
    order = [F.asc("finish"), F.asc_nulls_last("source"), F.asc("before"), F.asc("copy"), F.asc("piece")]
    placed, ahead = running_sums(binned.where(F.col("bin") <= end).drop("bin"), order, ["words"], "mix-packets")
    ahead = F.broadcast(ahead.withColumnRenamed("part", "p"))  # a row a range
    placed = placed.join(ahead, F.col("part") == F.col("p")).withColumn("at", F.col("words_ahead") + F.col("words_inside"))
    words = F.least(F.col("words"), budget - F.col("at"))
    return placed.where(F.col("at") < budget).select("source", "row", "before", "copy", "piece", words.alias("words"), "finish", "at")


def copies(queued: DataFrame, budget: int | None = None) -> DataFrame:
    """(row, copy, words, at): the copies that the mix takes, words of each, and the place of its first word in the mix."""
    return mix(queued, budget).groupBy("row", "copy").agg(F.sum("words").alias("words"), F.min("at").alias("at"))


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_at) of every document, taken or not; first_at is its first place in the mix."""
    queued = materialise(queue(docs), "mix-queued")
    taken = copies(queued).groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("words"), F.min("at").alias("first_at"))
    joined = queued.join(taken, F.col("row") == F.col("r"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_at")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and where in the mix it is first taken."""
    return mixture(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, a row for every copy taken, sorted by place in the mix; a copy of which not all packets are taken has its first words.

    Every row is a document of its own. Rows are known by two hashes of their contents; equal rows, which nothing can tell
    apart, share one text, which is dealt out again to as many parts as they have thousands of rows.
    """
    a, b, several, salt, at, words, size = unused(docs.columns, "a", "b", "several", "salt", "at", "words", "size")
    hashed = docs.withColumns({a: content_hash(docs, 1), b: content_hash(docs, 2)})
    queued = materialise(queue(hashed.select("doc_id", "source", "text", F.col(a).alias("a"), F.col(b).alias("b")), "a", "b"), "mix-queued")
    taken = copies(queued).withColumnRenamed("row", "r")
    taken = queued.select("row", "size", "a", "b").join(taken, F.col("row") == F.col("r"))
    taken = taken.select(F.col("a").alias(a), F.col("b").alias(b), F.col("words").alias(words), F.col("size").alias(size), F.col("at").alias(at))
    again = materialise(queued.groupBy(F.struct(F.col("a").alias(a), F.col("b").alias(b)).alias("key")).agg(F.count("*").alias("n")).where("n > 1"), "mix-repeated")
    if again.isEmpty():
        mixed = hashed.join(taken, [a, b])
    else:
        pair = F.struct(a, b)
        texts = hashed.join(again.select(F.col("key").alias(several)), pair == F.col(several), "left_semi").groupBy(a, b).agg(F.first(F.struct(*quoted(docs))).alias(several))
        texts = texts.join(again, pair == F.col("key")).withColumn(salt, F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 1_000).cast("int"))))
        texts = texts.select(a, b, *[F.col(f"{several}.`{c}`").alias(c) for c in docs.columns], salt)
        salted = lookup(taken.withColumn("key", pair), again, "key", "n", queued.count()).withColumn(salt, F.pmod(F.xxhash64(at), F.floor(F.col("n") / 1_000) + 1).cast("int"))
        repeated = texts.join(salted.drop("key", "n"), [a, b, salt]).drop(salt)
        keys = again.select(F.col("key").alias(several))
        mixed = hashed.join(taken.join(keys, pair == F.col(several), "left_anti"), [a, b]).unionByName(repeated)
    cut = F.col(words) < F.col(size)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), "")
    mixed = mixed.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    # places are even over the budget, so ranges of them need no sample
    total = queued.agg(F.sum("size")).first()[0] or 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(parts, F.floor(F.col(at) * parts / total).cast("int")).sortWithinPartitions(at).select(*quoted(docs))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per
), levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_weight,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighed
), level AS (
  SELECT left_size AS s, left_weight AS w FROM levelled WHERE left_size / left_weight <= cap / weight ORDER BY place LIMIT 1
), target AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * s / w) AS target FROM levelled, level
), queued AS (
  SELECT row_number() OVER () AS row, doc_id, t.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
), packets AS (
  SELECT row, source, ahead, copy, piece, least(128, size - 128 * piece) AS words,
         (ahead + copy * source_size + 128 * piece + least(128, size - 128 * piece)) / target AS finish
  FROM queued, unnest(range(3)) AS c(copy), unnest(range((size + 127) // 128)) AS p(piece) WHERE target > 0
), placed AS (
  SELECT row, words, coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, ahead, copy, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM packets
), taken AS (
  SELECT row, sum(least(words, (SELECT sum(size) FROM sized) - begins)) AS words, min(begins) AS first_at FROM placed WHERE begins < (SELECT sum(size) FROM sized) GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken, first_at FROM queued LEFT JOIN taken USING (row)
"""
