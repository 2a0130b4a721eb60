"""Registered: audits of a batch alone, and substring search by postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import audit_deltas as AD
from larder.operators import name_index as NI
from larder.plans import driver_queries, driver_raw  # noqa: F401 - the texts of their queries
from larder.plans.registry import REGISTRY, register
from larder.session import scratch_path


def careless_edits(t) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The edits of ``driver_raw.faulty`` as changed rows, before and after."""
    none = lambda df: df.limit(0)
    promo = t.food_listings.where(F.col("Food_Type") == "PROMO")
    gone = t.providers.where(F.col("Type").eqNullSafe("AFRICA"))
    twice = t.claims.where(F.col("Status") == "Cancelled")
    return {
        "providers": (gone, none(gone)),
        "food_listings": (promo, promo.withColumn("Food_ID", F.lit(None).cast("bigint"))),
        "claims": (none(twice), twice),
    }


# What the full audits find after the edits: nothing was wrong before them.
_CTES, _PK = REGISTRY["pk_violations_faulty"].oracle.split("SELECT 'providers' AS table_name", 1)
_FK = REGISTRY["fk_violations_faulty"].oracle[len(_CTES):]
_KEY_OF = "CASE table_name WHEN 'providers' THEN 'Provider_ID' WHEN 'receivers' THEN 'Receiver_ID' WHEN 'food_listings' THEN 'Food_ID' ELSE 'Claim_ID' END"


@register(
    "audit_of_a_batch",
    f"""{_CTES} SELECT 'appeared' AS change, table_name, {_KEY_OF} AS column_name, key_value, n_rows
        FROM (SELECT 'providers' AS table_name{_PK})
        UNION ALL SELECT 'appeared', child_table, column_name, key_value, n_rows FROM ({_FK})""",
)
def _batch(t):
    state = AD.audit_state(t.as_dict()).checkpoint(eager=True)
    return AD.audit_batch(state, careless_edits(t))[1]


@register("audit_of_a_batch_undone", f"""{_CTES} SELECT 'gone' AS change, table_name, {_KEY_OF} AS column_name, key_value, n_rows
        FROM (SELECT 'providers' AS table_name{_PK})
        UNION ALL SELECT 'gone', child_table, column_name, key_value, n_rows FROM ({_FK})""")
def _undone(t):
    # The edits taken back: every violation goes, none appears.
    state = AD.audit_state(t.as_dict()).checkpoint(eager=True)
    after, _ = AD.audit_batch(state, careless_edits(t))
    back = {table: (new, old) for table, (old, new) in careless_edits(t).items()}
    return AD.audit_batch(after.checkpoint(eager=True), back)[1]


def indexed(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Postings and their counts, written by gram."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "postings")
    NI.postings(rows, key, column).repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(path)
    index = spark.read.parquet(path)
    return index, NI.gram_counts(index)


@register(
    "indexed_search",
    """SELECT 'receivers' AS source, Receiver_ID AS key, Name AS name FROM receivers WHERE Name ILIKE '%er#0000000%9%'
       UNION ALL SELECT 'receivers', Receiver_ID, Name FROM receivers WHERE Name ILIKE '%STOMER#00000001%'
       UNION ALL SELECT 'receivers', Receiver_ID, Name FROM receivers WHERE Name ILIKE '%77%'
       UNION ALL SELECT 'listings', Food_ID, Food_Name FROM food_listings WHERE Food_Name ILIKE '%art%'
       UNION ALL SELECT 'listings', Food_ID, Food_Name FROM food_listings WHERE Food_Name ILIKE '%9 9%'""",
)
def _indexed(t):
    out = None
    for source, rows, key, column, patterns in (
        ("receivers", t.receivers, "Receiver_ID", "Name", ("er#0000000%9", "STOMER#00000001", "77")),
        ("listings", t.food_listings, "Food_ID", "Food_Name", ("art", "9 9")),
    ):
        index, counts = indexed(rows, key, column)
        for pattern in patterns:
            found = NI.search(rows, key, column, pattern, index, counts).select(
                F.lit(source).alias("source"), F.col(key).alias("key"), F.col(column).alias("name")
            )
            out = found if out is None else out.unionByName(found)
    return out
