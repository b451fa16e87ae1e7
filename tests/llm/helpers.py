"""Rows with every awkward case, and plain versions of what the operators find."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, more=()):
    """Documents with nulls in any column, empty, blank, repeated and long texts, and columns whose names clash."""
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", None), (3, "  \n\t ", "en", None, 4), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13),
        (None, "a text without an id " * 20, "en", "b", 1), (6, "é" * 3000, "fr", "b", 3000), (7, long_text, "en", "b", len(long_text)), (8, "a\x00b \x00 c", None, None, None), (9, "Ünïcode ワード 文字 " * 30, "ja", "c", 1),
    ]
    df = spark.createDataFrame(rows + list(more), DOCS)
    return df.selectExpr("*", "1 AS score", "2 AS size", "3 AS target", "'x' AS sig", "4 AS key", "'y' AS spans", "5 AS failed", "6 AS row", "7 AS hits")


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentences(seed, n, size=(5, 60), vocabulary=120):
    g = random.Random(seed)
    pool = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(g.choice(pool) for _ in range(g.randint(*size))) for _ in range(n)]
