"""URL filter: rules first, then a character language-model ratio; DataFrame operations only.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; its path follows up to ``?``, ``#`` or the end. A rule (host, path, verdict) fits its
host and all subdomains where the URL's path starts with the rule's; the longest fitting rule wins.

URLs that no rule decides are judged by two character models, of the URLs that rules accept and of
those they reject. They are variable-order Markov models up to ``ORDER`` characters of context with
Witten-Bell smoothing: P(x | h) = (c(hx) + T(h) P(x | h')) / (c(h) + T(h)), where h' drops h's first
character and T(h) is the number of different characters seen after h. A position counts with the
log ratio at the longest context after which its character was seen in either class. A URL's score
is the mean over its positions. The labelled URLs whose md5 starts below ``HELD_OUT`` are kept from the
counts and calibrate the threshold: the point that lies equally many standard deviations from the means of
both classes (0 if a class has none there).

Every URL is taken apart twice, once to count its n-grams and once to look up their log ratios; both
passes aggregate before they shuffle. A table of n-grams is broadcast if it was counted and has at
most ``BROADCAST_GRAMS`` rows; a larger one is joined by shuffling, but for the n-grams that make up
more than one in ``HOT_SHARE`` positions, which are broadcast.

Defined cases: a null URL or one without ``://`` has an empty host and path, and a null URL is judged
as the empty one; a very long URL is judged whole, by as many rows as it has characters; without
labelled URLs of both classes all URLs that no rule decides are allowed; a score equal to the threshold
is allowed; repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lookup, lower_ascii, table
from graphloom.session import materialise

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER, HELD_OUT, BROADCAST_GRAMS = 4, "3", 200_000
_START, _END = "\u0002", "\u0003"
_URL = "(?s)://([^/?#]*)([^?#]*)"


def host(url: Column | str) -> Column:
    """Host of a URL, empty if it has none."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column | str) -> Column:
    """Path of a URL, empty if it has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule(rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits columns host and path, else null."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _grams() -> Column:
    """Each character of ``url`` with the ORDER characters before it, in order."""
    padded = F.concat(F.lit(_START * ORDER), lower_ascii(F.coalesce("url", F.lit(""))), F.lit(_END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def _is_held_out() -> Column:
    return F.md5(F.coalesce("url", F.lit("")).cast("binary")) < HELD_OUT


def _side(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join: broadcast if it has few rows, never otherwise."""
    return F.broadcast(table) if rows <= BROADCAST_GRAMS else table.hint("merge")


def log_ratios(judged: DataFrame) -> DataFrame:
    """(gram, n, ratio): for each n-gram of (url, verdict), labelled or not, its number and the log ratio of both models."""
    counted = judged.select(F.explode(_grams()).alias("gram"), "verdict", _is_held_out().alias("out"))
    used = {c: F.sum(((F.col("verdict") == v) & ~F.col("out")).cast("long")) for c, v in (("a", "allow"), ("b", "block"))}
    all_grams = materialise(counted.groupBy("gram").agg(F.count("*").alias("n"), *[F.coalesce(x, F.lit(0)).alias(c) for c, x in used.items()]), "url-grams")
    seen = all_grams.where("a + b > 0").select("gram", "a", "b")
    # sizes[k]: how many different endings of k characters there are, which is the size of the k-th model
    sizes = [1, *seen.agg(*[F.count_distinct(F.right("gram", F.lit(k))) for k in range(1, ORDER + 2)]).first()]
    signs = sizes[1] + 1
    models: list[DataFrame] = []
    for k in range(1, ORDER + 2):
        own = seen.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        own = own.withColumn("h", F.left("gram", F.lit(k - 1)))
        after = own.groupBy("h").agg(*[F.sum(c).alias(f"n{c}") for c in "ab"], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ab"])
        joined = own.join(_side(after, sizes[k - 1]), "h")
        if k == 1:
            joined = joined.withColumns({"qa": F.lit(1 / signs), "qb": F.lit(1 / signs)})
        else:
            shorter = models[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            joined = joined.join(_side(shorter, sizes[k - 1]), F.right("gram", F.lit(k - 1)) == F.col("shorter"))
        smoothed = {f"p{c}": F.when(F.col(f"n{c}") == 0, F.col(f"q{c}")).otherwise((F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))) for c in "ab"}
        models.append(materialise(joined.select("gram", *[p.alias(c) for c, p in smoothed.items()]), f"url-model-{k}"))
    found = all_grams.select("gram", "n")
    for k, model in enumerate(models, 1):
        found = found.join(_side(model.select(F.col("gram").alias(f"g{k}"), F.log(F.col("pa") / F.col("pb")).alias(f"r{k}")), sizes[k]), F.right("gram", F.lit(k)) == F.col(f"g{k}"), "left")
    longest = reduce(lambda x, k: F.coalesce(x, F.col(f"r{k}")), range(ORDER, 0, -1), F.col(f"r{ORDER + 1}"))
    return found.select("gram", "n", F.coalesce(longest, F.lit(0.0)).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) of every page; score is null where a rule decides."""
    split = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"))
    ruled = split.withColumn("r", rule(rules)).select("page_id", "url", "host", "path", "r.rule", "r.verdict")
    ratios = materialise(log_ratios(ruled.select("url", "verdict")), "url-ratios")
    held = ratios.agg(F.count("*").alias("rows"), F.sum("n").alias("positions")).first()
    grams = ruled.select("page_id", "url", "rule", "verdict", F.posexplode(_grams()).alias("at", "gram"))
    grams = grams.where(F.col("rule").isNull() | _is_held_out())
    if held["rows"] <= BROADCAST_GRAMS:
        scored = grams.join(F.broadcast(ratios.drop("n")), "gram")
    else:
        scored = lookup(grams, ratios, "gram", "n", held["positions"])
    score = F.round(F.sum("ratio") / F.count("*"), 9).alias("score")
    rows = F.sum((F.col("at") == 0).cast("int")).alias("rows")
    scored = materialise(scored.groupBy("page_id", "url", "rule", "verdict").agg(score, rows), "url-scores")
    known = scored.where("rule is not null").groupBy("verdict").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("score")).alias("s"), F.sum(F.col("rows") * F.col("score") * F.col("score")).alias("ss"))
    limit = threshold({r["verdict"]: (r["n"], r["s"], r["ss"]) for r in known.collect()})
    chosen = F.when(F.col("score") >= limit, "allow").otherwise("block")
    others = scored.where("rule is null").withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    others = others.select("page_id", "url", host("url").alias("host"), path("url").alias("path"), "rule", chosen.alias("verdict"), "score")
    decided = ruled.where("rule is not null").withColumn("score", F.lit(None).cast("double"))
    return decided.union(others)


def threshold(known: dict[str, tuple[int, float, float]]) -> float:
    """The calibrated threshold from (rows, sum, sum of squares) of the held-out scores of each verdict."""
    if {"allow", "block"} - known.keys():
        return 0.0
    mean = {v: s / n for v, (n, s, _) in known.items()}
    spread = {v: max(0.0, ss / n - mean[v] ** 2) ** 0.5 for v, (n, _, ss) in known.items()}
    if not sum(spread.values()):
        return round(sum(mean.values()) / 2, 9)
    return round((mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / sum(spread.values()), 9)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    parts = [f"""split AS (
  SELECT page_id, url, {lower.format(r"regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), ruled AS (
  SELECT row_number() OVER () AS row, page_id, url, host, path, r.rule AS rule, r.verdict AS verdict,
         md5(coalesce(url, '')) < '{HELD_OUT}' AS out
  FROM (SELECT *, CASE {cases} END AS r FROM split)
), grams AS (
  SELECT row, verdict, out, substr(padded, i + 1, {ORDER + 1}) AS gram
  FROM (SELECT *, repeat(chr(2), {ORDER}) || {lower.format("coalesce(url, '')")} || chr(3) AS padded FROM ruled), unnest(range(length(padded) - {ORDER})) AS t(i)
), everything AS (
  SELECT gram, count(*) FILTER (verdict = 'allow' AND NOT out) AS a, count(*) FILTER (verdict = 'block' AND NOT out) AS b FROM grams GROUP BY gram
), p0 AS (SELECT '' AS gram, 1.0::DOUBLE / (count(DISTINCT right(gram, 1)) + 1) AS pa, 1.0::DOUBLE / (count(DISTINCT right(gram, 1)) + 1) AS pb FROM everything WHERE a + b > 0)"""]
    for k in range(1, ORDER + 2):
        parts.append(f"""c{k} AS (SELECT right(gram, {k}) AS gram, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM everything WHERE a + b > 0 GROUP BY 1),
h{k} AS (SELECT left(gram, {k - 1}) AS h, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM c{k} GROUP BY 1),
p{k} AS (SELECT c.gram, CASE WHEN na = 0 THEN q.pa ELSE (a + ta * q.pa) / (na + ta) END AS pa, CASE WHEN nb = 0 THEN q.pb ELSE (b + tb * q.pb) / (nb + tb) END AS pb
  FROM c{k} c JOIN h{k} ON left(c.gram, {k - 1}) = h JOIN p{k - 1} q ON right(c.gram, {k - 1}) = q.gram)""")
    joins = " ".join(f"LEFT JOIN p{k} ON right(e.gram, {k}) = p{k}.gram" for k in range(1, ORDER + 2))
    longest = ", ".join(f"ln(p{k}.pa / p{k}.pb)" for k in range(ORDER + 1, 0, -1))
    parts.append(f"""ratios AS (SELECT e.gram, coalesce({longest}, 0) AS ratio FROM everything e {joins}),
scored AS (SELECT row, round(sum(ratio) / count(*), 9) AS score FROM grams JOIN ratios USING (gram) GROUP BY row),
known AS (SELECT verdict, avg(score) AS m, sqrt(greatest(0, avg(score * score) - avg(score) ** 2)) AS s FROM scored JOIN ruled USING (row) WHERE out GROUP BY verdict),
cut AS (SELECT coalesce((SELECT CASE WHEN x.s + y.s > 0 THEN (x.m * y.s + y.m * x.s) / (x.s + y.s) ELSE (x.m + y.m) / 2 END FROM known x, known y WHERE x.verdict = 'allow' AND y.verdict = 'block'), 0) AS t)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= (SELECT t FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN scored USING (row)""")
    return "WITH " + ",\n".join(parts)


ORACLE = _oracle()
