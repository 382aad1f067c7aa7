"""Small tables with the cases that every operator must handle."""

from __future__ import annotations

import random

ROOTS = {"en": ["the", "and", "of", "tion", "ing", "er", "wh", "th"], "fr": ["que", "les", "ment", "eux", "ou", "ère", "é", "pour"], "de": ["und", "der", "sch", "ung", "keit", "ein", "ü", "ich"]}


def prose(rng: random.Random, lang: str, n: int) -> str:
    """Invented words of a language."""
    return " ".join("".join(rng.choices(ROOTS[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): prose, copies, near copies, junk, nulls, empty and one very long text."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(ROOTS))
        rows.append((k, prose(rng, lang, rng.randint(1, 120)), lang, f"s{rng.choice([0, 0, 0, 1, 2, 3])}"))
    long = rows[3][1] + " " + prose(rng, "en", 400)
    rows += [(n, rows[0][1], "en", "s0"), (n + 1, long, "en", "s1"), (n + 2, long.replace("the", "thé", 1), "en", "s1"), (n + 3, None, None, None), (n + 4, "", "en", None), (n + 5, "  \n\t\x0b ", "fr", "s2")]
    rows += [(n + 6, "12 345 !!! &&&", "de", "s2"), (n + 7, prose(rng, "en", 6000), "en", "s9"), (n + 8, "Ärger's d'été <|endoftext|> \x1c\x85 日本語 e\u0301 ÀB", "fr", "ß"), (n + 9, rows[0][1].upper(), "en", "s0")]
    rows += [(n + 10, prose(rng, "de", 30), None, "s3"), (n + 11, "x", "en", "s3"), (n + 12, "\x00a\x00b c", "en", "s3")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows: list[tuple] | None = None):
    """The documents with columns of clashing names, in three partitions."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "'x' as fp", "7L as size", "'y' as words", "'z' as ids", "array(1) as bucket", "1 as shard").repartition(3)
