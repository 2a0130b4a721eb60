"""Registered jobs over raw text, faulty tables and mixed change batches.

The inputs are the driver's tables written out the way raw files look: every
value as text, dates in many layouts, bad numbers, edge spaces, mixed case and
repeated rows.  What becomes of a row follows from its key, over all rows; the
oracle states the expected outcome and parses nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.coerce import coerce_date, coerce_timestamp, day_first_of, layout_counts
from larder.operators import changes as CH
from larder.operators import clean as CL
from larder.operators import integrity as IN
from larder.plans.driver_jobs import st
from larder.plans.registry import register
from larder.schemas import FOREIGN_KEYS, LOAD_ORDER, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS
from larder.session import ensure_checkpoint_dir, scratch_path
from larder.sources.csv import read_table_csv, read_table_csv_split, write_csv
from larder.sources.tables import create_schema, load_tables, scan_table

# Layouts that hold a date alone, and those with a time of day (to the second).
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-M-d", "yyyy/MM/dd", "yyyyMMdd", "MM-dd-yyyy", "M/d/yyyy", "MMM d, yyyy", "d MMMM yyyy")
TIME_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss'+02:00'", "M/d/yyyy H:mm:ss", "M/d/yyyy hh:mm:ss a", "yyyy/M/d H:mm:ss", "MMM d yyyy HH:mm:ss",
)


def rendered(value: Column, key: Column, layouts: tuple[str, ...]) -> Column:
    """``value`` as text, in the layout that the key's remainder picks."""
    out = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        out = F.when(F.pmod(key, F.lit(len(layouts))) == i, F.date_format(value, layout)).otherwise(out)
    return out


def through_csv(df: DataFrame, table: str) -> DataFrame:
    """Written as CSV (A5) below the shared folder and read as raw text (A1)."""
    path = scratch_path(df.sparkSession, f"raw_{table}")
    write_csv(df, path)
    return read_table_csv(df.sparkSession, path, table)


# --- C5: layouts -----------------------------------------------------------------------

_CLOCK = "to_seconds(Claim_ID % 86400)"


@register(
    "parse_date_layouts",
    f"""SELECT Claim_ID, CAST(Timestamp AS DATE) AS day, Timestamp + {_CLOCK} AS moment FROM claims""",
)
def _layouts(t):
    key = F.col("Claim_ID")
    clock = F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    text = t.claims.select(
        "Claim_ID",
        rendered(F.col("Timestamp"), key, DATE_LAYOUTS).alias("d"),
        rendered(F.col("Timestamp") + clock, key, TIME_LAYOUTS).alias("m"),
    )
    return text.select("Claim_ID", coerce_date("d").alias("day"), coerce_timestamp("m").alias("moment"))


# A column that is written day first; every second value would also read month first.
DAY_FIRST = ("dd/MM/yyyy", "d-M-yyyy", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy h:mm:ss a", "yyyy-MM-dd")


@register(
    "parse_day_first_column",
    """SELECT Claim_ID, CASE WHEN Claim_ID % 5 IN (2, 3) THEN Timestamp + to_seconds(Claim_ID % 86400) ELSE Timestamp END AS moment,
              CAST(Timestamp AS DATE) AS day FROM claims""",
)
def _day_first(t):
    key = F.col("Claim_ID")
    clock = F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    timed = F.pmod(key, F.lit(5)).isin(2, 3)
    moment = F.when(timed, F.col("Timestamp") + clock).otherwise(F.col("Timestamp"))
    text = t.claims.select("Claim_ID", rendered(moment, key, DAY_FIRST).alias("m"), F.date_format("Timestamp", "dd-MM-yyyy").alias("d"))
    # One layout a column, found from all of it.
    m, d = (day_first_of(layout_counts(text, c)) for c in ("m", "d"))
    return text.select("Claim_ID", coerce_timestamp("m", day_first=m).alias("moment"), coerce_date("d", day_first=d).alias("day"))


@register(
    "column_layouts",
    """SELECT 'day first' AS column_name, count(*) FILTER (day(Timestamp) > 12) AS n_day_first, CAST(0 AS BIGINT) AS n_month_first,
              count(*) FILTER (day(Timestamp) <= 12) AS n_open, count(*) FILTER (day(Timestamp) > 12) > 0 AS day_first FROM claims
       UNION ALL
       SELECT 'month first', CAST(0 AS BIGINT), count(*) FILTER (day(Timestamp) > 12), count(*) FILTER (day(Timestamp) <= 12), false FROM claims""",
)
def _column_layouts(t):
    # Counts of the two halves of each column, added up.
    out = None
    for name, layout in (("day first", "dd/MM/yyyy"), ("month first", "MM-dd-yyyy")):
        text = t.claims.select("Claim_ID", F.date_format("Timestamp", layout).alias("d"))
        halves = [layout_counts(text.where(F.pmod("Claim_ID", F.lit(2)) == i), "d") for i in (0, 1)]
        both = halves[0].unionByName(halves[1])
        one = both.agg(*[F.sum(c).alias(c) for c in both.columns]).select(
            F.lit(name).alias("column_name"), "*", day_first_of(both).alias("day_first")
        )
        out = one if out is None else out.unionByName(one)
    return out


# --- A1: lines that do not fit ------------------------------------------------------------


def faulty_lines(t) -> tuple[DataFrame, DataFrame]:
    """Claims as lines of text, of six keys in turn one with a field too many,
    one without its last and one without its last two fields, one with an open
    quote, one with a quoted comma; read back as rows and rejects."""
    turn = F.pmod("Claim_ID", F.lit(6))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("Claim_ID", "Food_ID", "Receiver_ID", "Status")]
    head, status, when = F.concat_ws(",", *parts[:3]), parts[3], F.date_format("Timestamp", "yyyy-MM-dd")
    line = (
        F.when(turn == 0, F.concat_ws(",", head, status, when, F.lit("more")))
        .when(turn == 1, F.concat_ws(",", head, status))
        .when(turn == 2, head)
        .when(turn == 3, F.concat(head, F.lit(',"'), status, F.lit(","), when))
        .when(turn == 4, F.concat(head, F.lit(',"'), status, F.lit(', ""so""",'), when))
        .otherwise(F.concat_ws(",", head, status, when))
    )
    path = scratch_path(t.spark, "claim_lines")
    t.claims.select(line.alias("value")).write.text(path)
    return read_table_csv_split(t.spark, path, "claims", header=False)


@register(
    "split_lines_rows",
    """SELECT CAST(Claim_ID AS VARCHAR) AS Claim_ID, CAST(Food_ID AS VARCHAR) AS Food_ID, CAST(Receiver_ID AS VARCHAR) AS Receiver_ID,
              CASE Claim_ID % 6 WHEN 2 THEN NULL WHEN 4 THEN Status || ', "so"' ELSE Status END AS Status,
              CASE WHEN Claim_ID % 6 IN (1, 2) THEN NULL ELSE strftime(Timestamp, '%Y-%m-%d') END AS Timestamp
       FROM claims WHERE Claim_ID % 6 NOT IN (0, 3)""",
)
def _split_rows(t):
    return faulty_lines(t)[0]


@register(
    "split_lines_rejects",
    """SELECT concat_ws(',', Claim_ID, coalesce(CAST(Food_ID AS VARCHAR), ''), coalesce(CAST(Receiver_ID AS VARCHAR), ''))
              || CASE WHEN Claim_ID % 6 = 0 THEN ',' || Status || ',' || strftime(Timestamp, '%Y-%m-%d') || ',more'
                      ELSE ',"' || Status || ',' || strftime(Timestamp, '%Y-%m-%d') END AS line,
              CASE WHEN Claim_ID % 6 = 0 THEN 'too many fields' ELSE 'open quote' END AS reason
       FROM claims WHERE Claim_ID % 6 IN (0, 3)""",
)
def _split_rejects(t):
    return faulty_lines(t)[1]


# --- C5, C6, C8-C10: raw listings and claims ------------------------------------------------


def raw_listings(listings: DataFrame) -> DataFrame:
    """Listings as raw text: of 9 keys in turn one has a NaN, one a word, one a
    negative and one a zero quantity, one a decimal point, one a bad date; every
    third row comes twice, in another case and with spaces at its edges."""
    key = F.col("Food_ID")
    turn = F.pmod(key, F.lit(9))
    q = F.col("Quantity").cast("string")
    quantity = (
        F.when(turn == 0, "nan").when(turn == 1, "two").when(turn == 2, F.concat(F.lit("-"), q))
        .when(turn == 3, "0").when(turn == 4, F.concat(q, F.lit(".0"))).otherwise(q)
    )
    expiry = F.when(turn == 5, "2025-13-45").otherwise(rendered(F.col("Expiry_Date"), key, DATE_LAYOUTS))
    texts = {c: F.col(c) for c in CL.LISTING_TITLE_COLUMNS}
    once = listings.select(
        *[{"Quantity": quantity, "Expiry_Date": expiry}.get(c, F.col(c)).cast("string").alias(c) for c in listings.columns]
    )
    again = once.where(F.pmod(F.col("Food_ID").cast("bigint"), F.lit(3)) == 0).select(
        *[F.concat(F.lit("  "), F.upper(texts[c]), F.lit("\t")).alias(c) if c in texts else F.col(c) for c in once.columns]
    )
    return once.unionByName(again)


@register(
    "clean_raw_food_listings",
    f"""SELECT Food_ID, {st('Food_Name')} AS Food_Name, Quantity,
               CASE WHEN Food_ID % 9 = 5 THEN NULL ELSE Expiry_Date END AS Expiry_Date, Provider_ID,
               {st('Provider_Type')} AS Provider_Type, {st('Location')} AS Location,
               {st('Food_Type')} AS Food_Type, {st('Meal_Type')} AS Meal_Type
        FROM food_listings WHERE Quantity > 0 AND Food_ID % 9 NOT IN (0, 1, 2, 3)""",
)
def _raw_listings(t):
    return CL.clean_listings(through_csv(raw_listings(t.food_listings), "food_listings"))


def raw_claims(claims: DataFrame) -> DataFrame:
    """Claims as raw text: of 7 keys in turn one has a bad date, one none, one a
    negative Food_ID, one a word as Receiver_ID, one a decimal point in its key;
    every second row comes twice, with its status in another case."""
    key = F.col("Claim_ID")
    turn = F.pmod(key, F.lit(7))
    values = {
        "Claim_ID": F.when(turn == 4, F.concat(key.cast("string"), F.lit(".0"))).otherwise(key.cast("string")),
        "Food_ID": F.when(turn == 2, (-F.col("Food_ID")).cast("string")).otherwise(F.col("Food_ID").cast("string")),
        "Receiver_ID": F.when(turn == 3, "nobody").otherwise(F.col("Receiver_ID").cast("string")),
        "Status": F.lower("Status"),
        "Timestamp": F.when(turn == 0, "the day before").when(turn == 1, "N/A").otherwise(
            rendered(F.col("Timestamp"), key, TIME_LAYOUTS)
        ),
    }
    once = claims.select(*[values[c].alias(c) for c in claims.columns])
    again = claims.where(F.pmod(key, F.lit(2)) == 0).select(
        *[(F.concat(F.upper("Status"), F.lit(" ")) if c == "Status" else values[c]).alias(c) for c in claims.columns]
    )
    return once.unionByName(again)


@register(
    "clean_raw_claims",
    f"""SELECT Claim_ID, Food_ID, Receiver_ID, {st('Status')} AS Status, Timestamp FROM claims
        WHERE Claim_ID > 0 AND Food_ID > 0 AND Receiver_ID > 0 AND Timestamp IS NOT NULL
          AND Claim_ID % 7 NOT IN (0, 1, 2, 3)""",
)
def _raw_claims(t):
    return CL.clean_claims(through_csv(raw_claims(t.claims), "claims"))


@register(
    "unparsed_claim_dates",
    "SELECT CAST(Claim_ID AS VARCHAR) AS Claim_ID, 'the day before' AS Timestamp FROM claims WHERE Claim_ID % 7 = 0 "
    "UNION ALL SELECT CAST(Claim_ID AS VARCHAR), 'the day before' FROM claims WHERE Claim_ID % 14 = 0",
)
def _unparsed(t):
    return CL.unparsed_dates(through_csv(raw_claims(t.claims), "claims"), "claims").select("Claim_ID", "Timestamp")


# --- I1-I3 on tables that break the rules ------------------------------------------------------


def faulty(t) -> dict[str, DataFrame]:
    """The tables after careless edits: cancelled claims entered twice, listings
    of one type without a key, the providers of one region gone, long names."""
    key = F.when(F.col("Food_Type") == "PROMO", F.lit(None)).otherwise(F.col("Food_ID")).cast("bigint")
    long = F.when(F.col("City") == "NATION_3", F.repeat("Name", 20)).otherwise(F.col("Name"))
    return {
        "providers": t.providers.where(~F.col("Type").eqNullSafe("AFRICA")).withColumn("Name", long),
        "receivers": t.receivers.withColumn("Name", long),
        "food_listings": t.food_listings.withColumn("Food_ID", key),
        "claims": t.claims.unionByName(t.claims.where(F.col("Status") == "Cancelled")),
    }


_FAULTY_SQL = """, f_providers AS (
  SELECT Provider_ID, CASE WHEN City = 'NATION_3' THEN repeat(Name, 20) ELSE Name END AS Name, Type, Address, City, Contact
  FROM providers WHERE Type IS DISTINCT FROM 'AFRICA'),
f_receivers AS (SELECT * REPLACE (CASE WHEN City = 'NATION_3' THEN repeat(Name, 20) ELSE Name END AS Name) FROM receivers),
f_food_listings AS (SELECT * REPLACE (CASE WHEN Food_Type = 'PROMO' THEN NULL ELSE Food_ID END AS Food_ID) FROM food_listings),
f_claims AS (SELECT * FROM claims UNION ALL SELECT * FROM claims WHERE Status = 'Cancelled')
"""


@register(
    "pk_violations_faulty",
    _FAULTY_SQL + " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, {k} AS key_value, COUNT(*) AS n_rows FROM f_{tb} "
        f"GROUP BY {k} HAVING COUNT(*) > 1 OR {k} IS NULL"
        for tb, k in PRIMARY_KEYS.items()
    ),
)
def _pk_faulty(t):
    return IN.pk_violations(faulty(t))


@register(
    "fk_violations_faulty",
    _FAULTY_SQL + " UNION ALL ".join(
        f"SELECT '{fk.child}' AS child_table, '{fk.column}' AS column_name, c.{fk.column} AS key_value, "
        f"COUNT(*) AS n_rows FROM f_{fk.child} c WHERE c.{fk.column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM f_{fk.parent} p WHERE p.{PRIMARY_KEYS[fk.parent]} = c.{fk.column}) GROUP BY c.{fk.column}"
        for fk in FOREIGN_KEYS
    ),
)
def _fk_faulty(t):
    return IN.fk_violations(faulty(t))


@register(
    "length_violations_faulty",
    _FAULTY_SQL + " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, '{c}' AS column_name, {PRIMARY_KEYS[tb]} AS key_value, "
        f"CAST(length({c}) AS INTEGER) AS length, {n} AS max_length FROM f_{tb} WHERE length({c}) > {n}"
        for tb, cols in MAX_LENGTHS.items() for c, n in cols.items()
    ),
)
def _length_faulty(t):
    return IN.length_violations(faulty(t))


# --- M: a mixed batch, row order by seq ---------------------------------------------------------


def mixed_batch(receivers: DataFrame) -> DataFrame:
    """I, U and D changes of ``receivers`` by segment, several to a key:

    BUILDING    renamed, deleted, entered again, moved
    AUTOMOBILE  entered again (the key is taken), renamed
    MACHINERY   deleted, renamed (too late)
    HOUSEHOLD   a new key: entered, entered again, renamed
    FURNITURE   a new key: entered, deleted
    """
    steps = {
        "BUILDING": (0, [("U", "Name", "early"), ("D", None, None), ("I", None, "again"), ("U", "City", "moved")]),
        "AUTOMOBILE": (0, [("I", None, "taken"), ("U", "Name", "renamed")]),
        "MACHINERY": (0, [("D", None, None), ("U", "Name", "late")]),
        "HOUSEHOLD": (10**9, [("I", None, "new"), ("I", None, "newer"), ("U", "Name", "named")]),
        "FURNITURE": (2 * 10**9, [("I", None, "short"), ("D", None, None)]),
    }

    def change(seq: int, op: str, column: str | None, value: str | None) -> Column:
        given = {column or "Name": F.lit(value)}
        if op == "I":
            given |= {"Type": F.lit("NEW"), "City": F.lit("somewhere")}
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"),
            (F.array(F.lit(column)) if op == "U" else F.array().cast("array<string>")).alias("set"),
            *[given.get(c, none).cast("string").alias(c) for c in ("Name", "Type", "City", "Contact")],
        )

    moved, listed = F.lit(0).cast("bigint"), F.array().cast("array<struct<op:string,seq:bigint,set:array<string>,Name:string,Type:string,City:string,Contact:string>>")
    for segment, (shift, changes) in steps.items():
        here = F.col("Type") == segment
        moved = F.when(here, F.lit(shift).cast("bigint")).otherwise(moved)
        listed = F.when(here, F.array(*[change(i + 1, *c) for i, c in enumerate(changes)])).otherwise(listed)
    # One pass: a row gives its changes side by side.
    return receivers.select((F.col("Receiver_ID") + moved).alias("Receiver_ID"), F.explode(listed).alias("c")).select("Receiver_ID", "c.*")


_MIXED_SQL = """SELECT Receiver_ID,
         CASE Type WHEN 'BUILDING' THEN 'again' WHEN 'AUTOMOBILE' THEN 'renamed' ELSE Name END AS Name,
         CASE Type WHEN 'BUILDING' THEN 'NEW' ELSE Type END AS Type,
         CASE Type WHEN 'BUILDING' THEN 'moved' ELSE City END AS City,
         CASE Type WHEN 'BUILDING' THEN NULL ELSE Contact END AS Contact
  FROM receivers WHERE Type IS DISTINCT FROM 'MACHINERY'
  UNION ALL
  SELECT Receiver_ID + 1000000000, 'named', 'NEW', 'somewhere', NULL FROM receivers WHERE Type = 'HOUSEHOLD'"""


@register("mixed_changes", _MIXED_SQL)
def _mixed(t):
    return CH.apply_changes({"receivers": t.receivers}, "receivers", mixed_batch(t.receivers))["receivers"]


@register("mixed_changes_replayed", _MIXED_SQL)
def _replayed(t):
    # The same batch again changes nothing.
    batch = mixed_batch(t.receivers)
    once = CH.apply_changes({"receivers": t.receivers}, "receivers", batch)
    return CH.apply_changes(once, "receivers", batch)["receivers"]


@register(
    "mixed_changes_rejected",
    """SELECT Receiver_ID, CAST(1 AS BIGINT) AS seq FROM receivers WHERE Type = 'AUTOMOBILE'
       UNION ALL
       SELECT Receiver_ID + 1000000000, CAST(2 AS BIGINT) FROM receivers WHERE Type = 'HOUSEHOLD'""",
)
def _rejected(t):
    return CH.rejected_inserts({"receivers": t.receivers}, "receivers", mixed_batch(t.receivers))


# --- A6-A8: export, create, load, load again -------------------------------------------------------


@register(
    "export_receivers_csv",
    """SELECT CAST(Receiver_ID AS VARCHAR) AS Receiver_ID, '  ' || Name || ' ' AS Name,
              '"' || Type || '", ' AS Type, City || chr(10) AS City, Contact FROM receivers""",
)
def _export(t):
    # Edge spaces, quotes, the delimiter and newlines survive the way out and back.
    odd = t.receivers.select(
        "Receiver_ID", F.concat(F.lit("  "), F.col("Name"), F.lit(" ")).alias("Name"),
        F.concat(F.lit('"'), F.col("Type"), F.lit('", ')).alias("Type"),
        F.concat(F.col("City"), F.lit("\n")).alias("City"), "Contact",
    )
    return through_csv(odd, "receivers")


def row_text(columns: list[str]) -> str:
    """SQL of a row as one text, the same in both engines."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS {{text}}), '-')" for c in columns) + ")"


@register(
    "load_reload_tables",
    " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, {k} AS key_value, {row_text(SCHEMAS[tb].names).format(text='VARCHAR')} AS row_text FROM {tb}"
        for tb, k in PRIMARY_KEYS.items()
    ),
)
def _load(t):
    # Created in a new database, loaded with every row given twice, loaded again.
    spark = t.spark
    base = scratch_path(spark, "database")
    name = "larder_" + os.path.basename(base).rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{base}'")
    create_schema(spark, name, base)
    create_schema(spark, name, base)
    tables = t.as_dict()
    load_tables(spark, {n: df.unionByName(df) for n, df in tables.items()}, name)
    load_tables(spark, tables, name)
    out = None
    for n in LOAD_ORDER:
        one = scan_table(spark, f"{name}.{n}").select(
            F.lit(n).alias("table_name"), F.col(PRIMARY_KEYS[n]).alias("key_value"),
            F.expr(row_text(SCHEMAS[n].names).format(text="STRING")).alias("row_text"),
        )
        out = one if out is None else out.unionByName(one)
    ensure_checkpoint_dir(spark)
    out = out.checkpoint(eager=True)
    # The database was for this load only; its tables' files lie in the scratch folder.
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return out
