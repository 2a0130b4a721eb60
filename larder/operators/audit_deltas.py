"""The audits I1-I3 for a batch of changes alone.

``audit_state`` counts, in one scan a table, every key and every reference.
A batch gives its changed rows as they were and as they are; their signed counts
are merged into the state, and only the keys that they touch are judged again: a
changed key with everything that may refer to it, a changed reference with the
key it names.  The tables themselves are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.integrity import length_violations
from larder.schemas import FOREIGN_KEYS, LOAD_ORDER, PRIMARY_KEYS, parents_of

#: (table, column) of each foreign key and the (table, column) that it refers to.
REFERS_TO = {(fk.child, fk.column): (fk.parent, PRIMARY_KEYS[fk.parent]) for fk in FOREIGN_KEYS}
SLOT = ("table_name", "column_name", "key_value")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _counted(rows: DataFrame, table: str, weight: int = 1) -> DataFrame:
    """(table_name, column_name, key_value, n_rows): the key and each non-null reference of the rows."""
    columns = [PRIMARY_KEYS[table], *[fk.column for fk in parents_of(table)]]
    slots = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("key_value")) for c in columns])
    told = rows.select(F.explode(slots).alias("s")).select(F.lit(table).alias("table_name"), "s.*")
    told = told.where((F.col("column_name") == PRIMARY_KEYS[table]) | F.col("key_value").isNotNull())
    return told.groupBy(*SLOT).agg((F.count(F.lit(1)) * weight).alias("n_rows"))


def audit_state(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_counted(tables[t], t) for t in LOAD_ORDER if t in tables])


def merged(*states: DataFrame) -> DataFrame:
    return _union(list(states)).groupBy(*SLOT).agg(F.sum("n_rows").alias("n_rows")).where("n_rows <> 0")


def violations(state: DataFrame) -> DataFrame:
    """(table_name, column_name, key_value, n_rows) of null or repeated keys and of references to no row."""
    keys = state.where(_is_key() & ((F.col("n_rows") > 1) | F.col("key_value").isNull()))
    return keys.unionByName(_named(state.where(~_is_key())).join(_keys_of(state), ["parent", "key_value"], "left_anti").select(*state.columns))


def _is_key() -> Column:
    out = F.lit(False)
    for table, column in PRIMARY_KEYS.items():
        out = out | ((F.col("table_name") == table) & (F.col("column_name") == column))
    return out


def _named(references: DataFrame) -> DataFrame:
    """References with the table that they name in ``parent``."""
    parent = F.lit(None).cast("string")
    for (child, column), (table, _) in REFERS_TO.items():
        parent = F.when((F.col("table_name") == child) & (F.col("column_name") == column), table).otherwise(parent)
    return references.withColumn("parent", parent)


def _keys_of(state: DataFrame) -> DataFrame:
    """(parent, key_value) of the keys that are there."""
    return state.where(_is_key() & F.col("key_value").isNotNull() & (F.col("n_rows") > 0)).select(F.col("table_name").alias("parent"), "key_value")


def _touched(delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots to judge again, slots that it takes to judge them)."""
    own = delta.select(*SLOT)
    parts = [own]
    for (child, column), (table, key) in REFERS_TO.items():
        # A changed key: whoever refers to it.
        changed = own.where((F.col("table_name") == table) & (F.col("column_name") == key) & F.col("key_value").isNotNull())
        parts.append(changed.select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "key_value"))
    judged = _union(parts).distinct()
    needed = [judged]
    for (child, column), (table, key) in REFERS_TO.items():
        named = judged.where((F.col("table_name") == child) & (F.col("column_name") == column))
        needed.append(named.select(F.lit(table).alias("table_name"), F.lit(key).alias("column_name"), "key_value"))
    return judged, _union(needed).distinct()


def _only(state: DataFrame, slots: DataFrame) -> DataFrame:
    """The rows of these slots, null keys too."""
    s = slots.select(*[F.col(c).alias(f"_{c}") for c in SLOT])
    same = (F.col("table_name") == F.col("_table_name")) & (F.col("column_name") == F.col("_column_name")) & F.col("key_value").eqNullSafe(F.col("_key_value"))
    return state.join(s, same, "left_semi")


def audit_batch(state: DataFrame, changed: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(the state after the batch, what the batch changed in the audits).

    ``changed``: per table its changed rows before and after.  The second result
    is (change, table_name, column_name, key_value, n_rows): violations that
    ``appeared`` or are ``gone``; one whose count changed is both.
    """
    parts = [_counted(rows, table, weight) for table, (before, after) in changed.items() for rows, weight in ((before, -1), (after, 1))]
    delta = merged(*parts).checkpoint(eager=True)
    judged, needed = _touched(delta)
    old = _only(state, needed).checkpoint(eager=True)
    was, now = (_only(violations(s), judged) for s in (old, merged(old, delta)))
    both = was.exceptAll(now).select(F.lit("gone").alias("change"), "*").unionByName(now.exceptAll(was).select(F.lit("appeared").alias("change"), "*"))
    return merged(state, delta), both


def length_changes(changed: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """I3 of a batch: (change, then the columns of ``length_violations``), from its rows alone."""
    was, now = (length_violations({t: pair[i] for t, pair in changed.items()}) for i in (0, 1))
    return was.exceptAll(now).select(F.lit("gone").alias("change"), "*").unionByName(now.exceptAll(was).select(F.lit("appeared").alias("change"), "*"))
