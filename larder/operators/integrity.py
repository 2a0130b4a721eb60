"""Key and reference audits (I1-I3): the table constraints as Spark jobs.

Parquet tables carry no primary or foreign keys, so the constraints of the
data model are checked as jobs that return the offending keys.  Each audit
aggregates first (count per key) and only then joins, so a key repeated
across a third of the table is one row by the time it reaches a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.schemas import FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, ForeignKey


def _union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pk_duplicates(df: DataFrame, key: str) -> DataFrame:
    """I1 for one table: (key_value, n_rows) for null or repeated keys."""
    counts = df.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("n_rows") > 1) | F.col("key_value").isNull())


def pk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_value, n_rows) over all tables given."""
    return _union_all([
        pk_duplicates(df, PRIMARY_KEYS[name]).select(
            F.lit(name).alias("table_name"), F.col("key_value").cast("bigint"), "n_rows"
        )
        for name, df in tables.items()
    ])


def fk_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """I2 quarantine: child rows whose non-null reference has no parent row."""
    parent_keys = parent.select(F.col(PRIMARY_KEYS[fk.parent]).alias("_parent_key"))
    c = child.where(F.col(fk.column).isNotNull())
    return c.join(parent_keys, c[fk.column] == parent_keys["_parent_key"], "left_anti")


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(child_table, column_name, key_value, n_rows) for dangling references."""
    frames = []
    for fk in FOREIGN_KEYS:
        if fk.child not in tables or fk.parent not in tables:
            continue
        per_key = tables[fk.child].where(F.col(fk.column).isNotNull()).groupBy(
            F.col(fk.column).alias("key_value")
        ).agg(F.count(F.lit(1)).alias("n_rows"))
        parent_keys = tables[fk.parent].select(F.col(PRIMARY_KEYS[fk.parent]).alias("_parent_key"))
        dangling = per_key.join(parent_keys, per_key.key_value == parent_keys._parent_key, "left_anti")
        frames.append(dangling.select(
            F.lit(fk.child).alias("child_table"), F.lit(fk.column).alias("column_name"),
            F.col("key_value").cast("bigint"), "n_rows",
        ))
    return _union_all(frames)


def length_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, key_value, length, max_length) for text
    longer than its declared VARCHAR length."""
    frames = []
    for name, df in tables.items():
        key = PRIMARY_KEYS[name]
        limits = MAX_LENGTHS.get(name, {})
        if not limits:
            continue
        # One pass per table: all limited columns of a row side by side.
        found = F.filter(
            F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.char_length(F.col(c)).cast("int").alias("length"), F.lit(n).alias("max_length"))
                for c, n in limits.items()
            ]),
            lambda x: x["length"] > x["max_length"],
        )
        frames.append(
            df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("key_value"), F.explode(found).alias("v"))
            .select("table_name", "v.column_name", "key_value", "v.length", "v.max_length")
        )
    return _union_all(frames)
