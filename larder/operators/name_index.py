"""Substring search by postings (F2, F3) instead of a scan of the texts.

``postings`` lists, for every three letters in a row of the lower-cased text, the
keys of the rows that hold them.  A search joins the postings of a few of the
pattern's rarest triples, so it reads those lists and then the rows of the
keys in all of them, which the exact ``ilike`` judges.  A pattern shorter than
three letters, or with wildcards, has no triple to look up and is a plain scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.filters import contains

SIZE = 3
#: Lists joined for a pattern: the rarest ones; the exact check does the rest.
LISTS = 3


def triples(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})


def postings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(gram, key): each triple of a text once a row."""
    low = F.lower(F.col(column))
    at = F.when(F.char_length(low) >= SIZE, F.sequence(F.lit(1), F.char_length(low) - (SIZE - 1)))
    grams = F.array_distinct(F.transform(at, lambda i: F.substr(low, i, F.lit(SIZE))))
    return rows.select(F.explode(grams).alias("gram"), F.col(key).alias("key"))


def gram_counts(index: DataFrame) -> DataFrame:
    """(gram, n): the length of each list."""
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def plain(pattern: str) -> bool:
    return len(pattern) >= SIZE and not set(pattern) & set("%_\\")


def search(rows: DataFrame, key: str, column: str, pattern: str, index: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose ``column`` contains ``pattern``, case-insensitive (as ``contains_filter``)."""
    exact = contains(column, pattern)
    if index is None or not plain(pattern):
        return rows.where(exact)
    wanted = triples(pattern)
    if counts is not None and len(wanted) > LISTS:
        # At most one row a triple of the pattern reaches the driver.
        known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(wanted)).collect()}
        wanted = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:LISTS]
    keys = None
    for gram in wanted:
        one = index.where(F.col("gram") == gram).select("key")
        keys = one if keys is None else keys.join(one, "key", "left_semi")
    keys = keys.select(F.col("key").alias("_key"))
    return rows.join(keys, F.col(key) == F.col("_key"), "left_semi").where(exact)
