"""Batches of changes over several tables, with their references checked (M1-M5 with I2).

``apply_batch`` applies inserts, updates and deletes of all tables in one order
of ``seq``, as a database with enforced keys would, without going through them
one by one.  Tables are taken parents first.  A key is alive in spans
[insert, delete) of ``seq``; every reference that a change assigns is joined
with the span of its parent that holds the change's ``seq``.  What remains to be
done in order, the few changes of a key that create it, end it or move its
references, is folded per key over sorted partitions, a key's state at a time.
Rows that no change names and whose parents all live on are never sorted: they
pass an anti join.

Rejected changes do nothing and are listed: an insert whose key is taken, an
insert or an update (the whole of it) that refers to a key not alive at that
moment.  Updates of rows that are not there are no errors and change nothing.
A deleted parent takes its rows along or clears their references, as the
foreign key says, at its own ``seq``.

``unapplied`` and ``next_ledger`` keep the last applied ``seq`` of every key, so
that a batch given twice is applied once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.changes import _conform, assign_ids, id_floor, update_rows
from larder.schemas import LOAD_ORDER, PRIMARY_KEYS, SCHEMAS, ForeignKey, parents_of
from larder.session import ensure_checkpoint_dir, written

#: The ``seq`` of what was there before the batch.
BEFORE = -(1 << 62)
TAKEN = "key is taken"


def missing_reason(fk: ForeignKey) -> str:
    return f"{fk.column} has no {fk.parent} row"


def numbered(changes: DataFrame, base: DataFrame, table: str, high_water: DataFrame | None = None) -> DataFrame:
    """The changes with a key for every insert (auto-increment in ``seq`` order), written once."""
    key = PRIMARY_KEYS[table]
    if key not in changes.columns:
        changes = changes.withColumn(key, F.lit(None).cast("bigint"))
    changes = changes.withColumn(key, F.col(key).cast("bigint"))
    unnamed = (F.col("op") == "I") & F.col(key).isNull()
    sources = [base.select(key), changes.where(F.col("op") == "I").select(key)]
    if high_water is not None:
        sources.append(high_water.select(F.col(high_water.columns[0]).cast("bigint").alias(key)))
    floor = id_floor(*sources, key=key)
    fresh = assign_ids(changes.where(unnamed), base, key, ["seq"], floor).select(*changes.columns)
    return changes.where(~unnamed).where(F.col(key).isNotNull()).unionByName(fresh).transform(written, f"changes_{table}")


def _events(base: DataFrame, changes: DataFrame, key: str, fks: list[ForeignKey]) -> DataFrame:
    """(key, seq, op, and per reference r<i>, its value, and a<i>, whether it is assigned)."""
    own = changes.select(F.col(key).alias("key")).distinct()
    there = base.join(own, base[key] == own["key"], "left_semi").select(
        F.col(key).alias("key"), F.lit(BEFORE).alias("seq"), F.lit("B").alias("op"),
        *[c for i, fk in enumerate(fks) for c in (F.col(fk.column).cast("bigint").alias(f"r{i}"), F.lit(True).alias(f"a{i}"))],
    )
    given = {fk.column for fk in fks if fk.column in changes.columns}

    def assigned(fk: ForeignKey):
        return F.coalesce((F.col("op") == "I") | ((F.col("op") == "U") & F.array_contains("set", fk.column)), F.lit(False))

    moving = F.col("op").isin("I", "D")
    for fk in fks:
        moving = moving | assigned(fk)
    told = changes.where(moving).select(
        F.col(key).alias("key"), F.col("seq").cast("bigint").alias("seq"), "op",
        *[
            c for i, fk in enumerate(fks)
            for c in ((F.col(fk.column) if fk.column in given else F.lit(None)).cast("bigint").alias(f"r{i}"), assigned(fk).alias(f"a{i}"))
        ],
    )
    return there.unionByName(told)


def _with_spans(events: DataFrame, i: int, spans: DataFrame) -> DataFrame:
    """The interval join: ``ok<i>`` if the assigned parent is alive at ``seq``, ``u<i>`` when it ends."""
    refers = F.col(f"a{i}") & F.col(f"r{i}").isNotNull()
    # Changes without a reference do not meet in the join's null key.
    free = events.where(~refers).withColumn(f"ok{i}", F.lit(True)).withColumn(f"u{i}", F.lit(None).cast("bigint"))
    here = (F.col(f"r{i}") == F.col("_parent")) & (F.col("_begin") <= F.col("seq")) & (F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    bound = events.where(refers).join(spans, here, "left").select(
        *events.columns, F.col("_parent").isNotNull().alias(f"ok{i}"), F.col("_end").alias(f"u{i}")
    )
    return free.unionByName(bound)


def _fold(events: DataFrame, fks: list[ForeignKey]) -> DataFrame:
    """(key, kind, begin, end, seq, reason, r<i>): lives that ended, rows alive at the end, rejected changes."""
    n = len(fks)
    cascades = [fk.on_delete == "cascade" for fk in fks]
    reasons = [missing_reason(fk) for fk in fks]
    fields = [("key", T.LongType()), ("kind", T.StringType()), ("begin", T.LongType()), ("end", T.LongType()), ("seq", T.LongType()), ("reason", T.StringType())]
    schema = T.StructType([T.StructField(c, t) for c, t in fields + [(f"r{i}", T.LongType()) for i in range(n)]])
    names = schema.names

    # Arrow keeps whole numbers whole where a column holds nulls.
    kinds = [pa.string() if c in ("kind", "reason") else pa.int64() for c in names]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = begin = None
        values: list = [None] * n
        until: list = [None] * n
        out: list[tuple] = []

        def settle(seq) -> None:
            """What the ends of parents before ``seq`` did to the row."""
            nonlocal begin
            if begin is None:
                return
            ends = [u for u, c in zip(until, cascades) if c and u is not None and (seq is None or u <= seq)]
            if ends:
                out.append((key, "life", begin, min(ends), None, None, *[None] * n))
                begin = None
                return
            for i in range(n):
                if not cascades[i] and until[i] is not None and (seq is None or until[i] <= seq):
                    values[i] = until[i] = None

        def close() -> None:
            settle(None)
            if begin is not None:
                out.append((key, "alive", begin, None, None, None, *values))

        for batch in batches:
            for k, seq, op, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refs = [rest[4 * i : 4 * i + 4] for i in range(n)]
                if k != key:
                    if key is not None:
                        close()
                    key, begin = k, None
                settle(seq)
                bad = next((i for i, (_, a, ok, _) in enumerate(refs) if a and not ok), None)
                if op == "D":
                    if begin is not None:
                        out.append((key, "life", begin, seq, None, None, *[None] * n))
                        begin = None
                elif op == "B" or (op == "I" and begin is None and bad is None):
                    begin = seq
                    values, until = [r[0] for r in refs], [r[3] for r in refs]
                elif op == "I":
                    out.append((key, "rejected", None, None, seq, TAKEN if begin is not None else reasons[bad], *[None] * n))
                elif begin is not None and bad is not None:
                    out.append((key, "rejected", None, None, seq, reasons[bad], *[None] * n))
                elif begin is not None:
                    for i, (value, a, _, end) in enumerate(refs):
                        if a:
                            values[i], until[i] = value, end
            if out:
                yield told(out)
                out = []
        if key is not None:
            close()
        if out:
            yield told(out)

    flat = ["key", "seq", "op", *[f"{c}{i}" for i in range(n) for c in ("r", "a", "ok", "u")]]
    return events.select(*flat).repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, schema)


def apply_batch(
    tables: dict[str, DataFrame], changes: dict[str, DataFrame], high_water: dict[str, DataFrame] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, (table_name, key_value, seq, reason) of the rejected changes).

    ``changes``: per table its changes (``op``, ``seq``, the key, ``set``, values);
    ``seq`` orders the changes of all tables.  ``high_water``: per table the
    highest key ever handed out, where deleted keys are not to be used again.

    A table is read by several steps: one that is derived from others costs as
    many derivations, unless it is written first (``session.written``).
    """
    spark = next(iter(tables.values())).sparkSession
    ensure_checkpoint_dir(spark)
    out = dict(tables)
    spans: dict[str, DataFrame] = {}  # of every key of a table that a child refers to
    ended: dict[str, DataFrame] = {}  # (_parent, _end) of keys of the old tables that end
    rejected = []
    for table in [t for t in LOAD_ORDER if t in tables]:
        base, key = tables[table], PRIMARY_KEYS[table]
        fks = [fk for fk in parents_of(table) if fk.parent in tables]
        told = changes.get(table)
        alive = lives = None
        rest = base
        if told is not None:
            told = numbered(told, base, table, (high_water or {}).get(table))
            events = _events(base, told, key, fks)
            for i, fk in enumerate(fks):
                events = _with_spans(events, i, spans[fk.parent])
            folded = written(_fold(events, fks), f"folded_{table}")
            rejected.append(folded.where("kind = 'rejected'").select(F.lit(table).alias("table_name"), F.col("key").alias("key_value"), "seq", "reason"))
            own = told.select(F.col(key).alias("_own")).distinct()
            rest = rest.join(own, base[key] == own["_own"], "left_anti")
            lives = folded.where("kind <> 'rejected'").select("key", "begin", "end")
            alive = _living(base, told, folded, table, fks)

        # Rows without changes of their own follow their parents.
        doomed = None
        for fk in fks:
            if fk.parent not in ended:
                continue
            hit = rest.where(F.col(fk.column).isNotNull()).join(ended[fk.parent], F.col(fk.column) == F.col("_parent"))
            if fk.on_delete == "cascade":
                gone = hit.select(F.col(key).alias("key"), F.col("_end").alias("end"))
                doomed = gone if doomed is None else doomed.unionByName(gone)
            else:
                clear = hit.select(F.col(key).alias("_cleared"))
                rest = rest.join(clear, rest[key] == clear["_cleared"], "left").select(
                    *[F.when(F.col("_cleared").isNull(), F.col(c)).alias(c) if c == fk.column else F.col(c) for c in base.columns]
                )
        if doomed is not None:
            doomed = written(doomed.groupBy("key").agg(F.min("end").alias("end")), f"doomed_{table}")
            rest = rest.join(doomed, rest[key] == doomed["key"], "left_anti")
            fallen = doomed.select("key", F.lit(BEFORE).alias("begin"), "end")
            lives = fallen if lives is None else lives.unionByName(fallen)
        out[table] = rest if alive is None else rest.unionByName(alive)

        # The spans of this table's keys, for the tables that refer to it.
        there = base.select(F.col(key).alias("_parent"), F.lit(BEFORE).alias("_begin"), F.lit(None).cast("bigint").alias("_end"))
        if lives is None and told is None:
            spans[table] = there
            continue
        if told is not None:
            there = there.join(own, there["_parent"] == own["_own"], "left_anti")
        if doomed is not None:
            there = there.join(doomed, there["_parent"] == doomed["key"], "left_anti")
        spans[table] = there.unionByName(lives.select(F.col("key").alias("_parent"), F.col("begin").alias("_begin"), F.col("end").alias("_end")))
        ended[table] = lives.where((F.col("begin") == BEFORE) & F.col("end").isNotNull()).select(F.col("key").alias("_parent"), F.col("end").alias("_end"))
    if not rejected:
        return out, spark.createDataFrame([], "table_name string, key_value long, seq long, reason string")
    every = rejected[0]
    for more in rejected[1:]:
        every = every.unionByName(more)
    return out, every


def _living(base: DataFrame, told: DataFrame, folded: DataFrame, table: str, fks: list[ForeignKey]) -> DataFrame:
    """The rows of changed keys that are alive at the end."""
    key = PRIMARY_KEYS[table]
    columns = [f.name for f in SCHEMAS[table].fields]
    alive = folded.where("kind = 'alive'").select(F.col("key").alias("_key"), F.col("begin").alias("_begin"), *[f"r{i}" for i in range(len(fks))])
    old = base.join(alive.where(F.col("_begin") == BEFORE), F.col(key) == F.col("_key")).select(*columns, *[f"r{i}" for i in range(len(fks))])
    inserts = told.where(F.col("op") == "I").join(alive, (F.col(key) == F.col("_key")) & (F.col("seq") == F.col("_begin")))
    held = [c for c in columns if c in told.columns]
    new = inserts.select(*held, *[f"r{i}" for i in range(len(fks))])
    refs = {fk.column: F.col(f"r{i}") for i, fk in enumerate(fks)}

    def placed(rows: DataFrame) -> DataFrame:
        moved = rows.select(*[refs[c].cast(rows.schema[c].dataType).alias(c) if c in refs else F.col(c) for c in rows.columns if c in columns],
                            *[r.alias(c) for c, r in refs.items() if c not in rows.columns])
        return _conform(moved, table)

    rows = placed(old).unionByName(placed(new))
    # Updates after the row's last beginning, but for the rejected ones.
    lost = folded.where("kind = 'rejected'").select(F.col("key").alias(key), "seq")
    later = told.where(F.col("op") == "U").join(alive.select(F.col("_key").alias(key), "_begin"), key).where("seq > _begin").drop("_begin")
    later = later.join(lost, [key, "seq"], "left_anti")
    plain = [c for c in columns if c != key and c not in refs and c in told.columns]
    return update_rows(rows, later, table, plain) if plain else rows


# --- replay: what a ledger says was applied ------------------------------------------

LEDGER = "key_value long, seq long"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unapplied(changes: DataFrame, ledger: DataFrame, table: str) -> DataFrame:
    """The changes that come after the last one applied to their key.

    ``ledger``: (key_value, seq), the last applied ``seq`` of each key; its row
    without a key holds that of the inserts that had none.
    """
    key = PRIMARY_KEYS[table]
    if key not in changes.columns:
        changes = changes.withColumn(key, F.lit(None).cast("bigint"))
    last = ledger.where("key_value is not null").select(F.col("key_value").alias("_k"), F.col("seq").alias("_last"))
    named = changes.where(F.col(key).isNotNull()).join(last, F.col(key) == F.col("_k"), "left")
    named = named.where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).select(*changes.columns)
    mark = ledger.where("key_value is null").select(F.coalesce(F.max("seq"), F.lit(BEFORE))).scalar()
    return named.unionByName(changes.where(F.col(key).isNull()).where(F.col("seq") > mark))


def next_ledger(ledger: DataFrame, changes: DataFrame, table: str) -> DataFrame:
    """The ledger after ``changes``: one row a key, whatever became of its changes."""
    key = PRIMARY_KEYS[table]
    told = changes.select((F.col(key) if key in changes.columns else F.lit(None)).cast("bigint").alias("key_value"), F.col("seq").cast("bigint").alias("seq"))
    return ledger.unionByName(told).groupBy("key_value").agg(F.max("seq").alias("seq"))


def apply_once(
    tables: dict[str, DataFrame], changes: dict[str, DataFrame], ledgers: dict[str, DataFrame], high_water: dict[str, DataFrame] | None = None
) -> tuple[dict[str, DataFrame], DataFrame, dict[str, DataFrame]]:
    """``apply_batch`` of what the ledgers do not hold yet: (tables, rejected, new ledgers), written before use."""
    spark = next(iter(tables.values())).sparkSession
    ensure_checkpoint_dir(spark)
    fresh, after = {}, dict(ledgers)
    for table, told in changes.items():
        held = ledgers.get(table)
        held = empty_ledger(spark) if held is None else held
        fresh[table] = unapplied(told, held, table).checkpoint(eager=True)
        after[table] = next_ledger(held, fresh[table], table).checkpoint(eager=True)
    out, rejected = apply_batch(tables, fresh, high_water)
    return {t: df.checkpoint(eager=True) for t, df in out.items()}, rejected, after
