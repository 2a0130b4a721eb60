"""Registered cleaning, profiling, integrity and change-application jobs.

All of them run over the whole driver-derived tables (and the whole
``documents.text`` values for the text cleaners).  Change batches are derived
from the tables themselves, so their size grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larder.functions.text import SEPARATOR_CLASS, WHITESPACE_CLASS, clean_address, clean_text, digits_only, strip_title
from larder.operators import changes as CH
from larder.operators import clean as CL
from larder.operators import filters as FL
from larder.operators import integrity as IN
from larder.operators import profile as PR
from larder.plans.registry import AS_OF, register
from larder.plans.sql import run_query
from larder.session import scratch_path
from larder.sources.csv import read_table_csv, write_csv
from larder.schemas import FOREIGN_KEYS, MAX_LENGTHS, PRIMARY_KEYS, SCHEMAS

# --- DuckDB spellings of the text cleaners (RE2 regex, same classes) ---------------
_WS = f"[{WHITESPACE_CLASS}]"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def ct(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WHITESPACE_CLASS}{SEPARATOR_CLASS}]+', ' ', 'g'))"


def ca(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def dg(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"


def st(x: str) -> str:
    stripped = f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    runs = f"regexp_extract_all({stripped}, '([{_CASED}]+|[^{_CASED}]+)', 1)"
    # Title case of the first letter is its upper case, except for letters
    # whose title form differs; the only one in these texts is the sharp s
    # (title "Ss", upper "SS" or capital sharp s depending on the engine).
    first = "CASE WHEN substring(w, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substring(w, 1, 1)) END"
    word = (f"CASE WHEN regexp_matches(w, '^[{_CASED}]') "
            f"THEN {first} || lower(substring(w, 2)) ELSE w END")
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform({runs}, lambda w: {word}), '') END"


# --- C: cleaning ------------------------------------------------------------------------

@register(
    "clean_providers",
    f"""SELECT Provider_ID, {ct('Name')} AS Name, {ct('Type')} AS Type, {ca('Address')} AS Address,
               {ct('City')} AS City, {dg('Contact')} AS Contact FROM providers""",
)
def _c_prov(t):
    return CL.clean_providers(t.providers)


@register(
    "clean_receivers",
    f"""SELECT Receiver_ID, {ct('Name')} AS Name, {ct('Type')} AS Type, {ct('City')} AS City,
               {dg('Contact')} AS Contact FROM receivers""",
)
def _c_recv(t):
    return CL.clean_receivers(t.receivers)


@register(
    "clean_food_listings",
    f"""SELECT DISTINCT Food_ID, {st('Food_Name')} AS Food_Name, Quantity, Expiry_Date, Provider_ID,
               {st('Provider_Type')} AS Provider_Type, {st('Location')} AS Location,
               {st('Food_Type')} AS Food_Type, {st('Meal_Type')} AS Meal_Type
        FROM food_listings WHERE Quantity > 0""",
)
def _c_list(t):
    return CL.clean_listings(t.food_listings)


@register(
    "clean_claims",
    f"""SELECT DISTINCT Claim_ID, Food_ID, Receiver_ID, {st('Status')} AS Status, Timestamp
        FROM claims
        WHERE Claim_ID > 0 AND Food_ID > 0 AND Receiver_ID > 0 AND Timestamp IS NOT NULL""",
)
def _c_claims(t):
    return CL.clean_claims(t.claims)


@register(
    "clean_documents_text",
    f"""SELECT doc_id, {ct('text')} AS clean_text, {ca('text')} AS clean_address, {dg('text')} AS digits
        FROM documents""",
)
def _c_docs(t):
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return docs.select(
        "doc_id",
        clean_text("text").alias("clean_text"),
        clean_address("text").alias("clean_address"),
        digits_only("text").alias("digits"),
    )


@register("title_documents", f"SELECT doc_id, {st('text')} AS title FROM documents")
def _c_docs_title(t):
    # Also checked against Python's str.title() on every document in tests.
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return docs.select("doc_id", strip_title("text").alias("title"))


# --- B: profiling ---------------------------------------------------------------------------

@register("table_shape_claims", "SELECT COUNT(*) AS n_rows, 5 AS n_cols FROM claims")
def _b1(t):
    return PR.table_shape(t.claims)


def _null_sql(table: str) -> str:
    cols = [f.name for f in SCHEMAS[table].fields]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM {table}" for c in cols
    )


@register("null_profile_food_listings", _null_sql("food_listings"))
def _b2a(t):
    return PR.null_profile(t.food_listings)


@register("null_profile_claims", _null_sql("claims"))
def _b2b(t):
    return PR.null_profile(t.claims)


def _profile_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f.name}' AS column_name, COUNT({f.name}) AS non_null_count, "
        f"'{f.dataType.simpleString()}' AS data_type FROM {table}"
        for f in SCHEMAS[table].fields
    )


@register("column_profile_food_listings", _profile_sql("food_listings"))
def _b3(t):
    return PR.column_profile(t.food_listings)


# The original profiles all four tables; the remaining combinations.
for _t in ("providers", "receivers", "food_listings"):
    register(f"table_shape_{_t}", f"SELECT COUNT(*) AS n_rows, {len(SCHEMAS[_t].fields)} AS n_cols FROM {_t}")(
        lambda t, _t=_t: PR.table_shape(getattr(t, _t)))
for _t in ("providers", "receivers"):
    register(f"null_profile_{_t}", _null_sql(_t))(lambda t, _t=_t: PR.null_profile(getattr(t, _t)))
for _t in ("providers", "receivers", "claims"):
    register(f"column_profile_{_t}", _profile_sql(_t))(lambda t, _t=_t: PR.column_profile(getattr(t, _t)))


for _t in ("providers", "food_listings", "claims"):
    register(f"preview_{_t}", f"SELECT * FROM {_t} ORDER BY {PRIMARY_KEYS[_t]} LIMIT 5")(
        lambda t, _t=_t: PR.preview(getattr(t, _t), PRIMARY_KEYS[_t], 5))


@register("preview_receivers", "SELECT * FROM receivers ORDER BY Receiver_ID LIMIT 5")
def _b4(t):
    return PR.preview(t.receivers, "Receiver_ID", 5)


# --- I: integrity audits ----------------------------------------------------------------------

@register(
    "pk_violations",
    " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, {k} AS key_value, COUNT(*) AS n_rows FROM {tb} "
        f"GROUP BY {k} HAVING COUNT(*) > 1 OR {k} IS NULL"
        for tb, k in PRIMARY_KEYS.items()
    ),
)
def _i1(t):
    return IN.pk_violations(t.as_dict())


@register(
    "fk_violations",
    " UNION ALL ".join(
        f"SELECT '{fk.child}' AS child_table, '{fk.column}' AS column_name, c.{fk.column} AS key_value, "
        f"COUNT(*) AS n_rows FROM {fk.child} c WHERE c.{fk.column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {fk.parent} p WHERE p.{PRIMARY_KEYS[fk.parent]} = c.{fk.column}) GROUP BY c.{fk.column}"
        for fk in FOREIGN_KEYS
    ),
)
def _i2(t):
    return IN.fk_violations(t.as_dict())


@register(
    "length_violations",
    " UNION ALL ".join(
        f"SELECT '{tb}' AS table_name, '{c}' AS column_name, {PRIMARY_KEYS[tb]} AS key_value, "
        f"CAST(length({c}) AS INTEGER) AS length, {n} AS max_length FROM {tb} WHERE length({c}) > {n}"
        for tb, cols in MAX_LENGTHS.items() for c, n in cols.items()
    ),
)
def _i3(t):
    return IN.length_violations(t.as_dict())


@register(
    "listing_orphans_after_raw_delete",
    """SELECT f.* FROM food_listings f WHERE f.Provider_ID IS NOT NULL AND NOT EXISTS
         (SELECT 1 FROM providers p WHERE p.Provider_ID = f.Provider_ID AND p.Type IS DISTINCT FROM 'AFRICA')""",
)
def _i2q(t):
    # Deleting providers without the SET NULL rule leaves dangling listings;
    # the quarantine query finds exactly those rows.
    kept = t.providers.where(~F.col("Type").eqNullSafe("AFRICA"))
    return IN.fk_orphans(t.food_listings, kept, FOREIGN_KEYS[0])


# --- M: change application ------------------------------------------------------------------

CUTOFF = dt.date(1996, 1, 1)
CUTOFF_SQL = "DATE '1996-01-01'"


@register(
    "delete_listings_cascade",
    f"""SELECT c.* FROM claims c WHERE NOT EXISTS
          (SELECT 1 FROM food_listings f WHERE f.Food_ID = c.Food_ID AND f.Expiry_Date < {CUTOFF_SQL})""",
)
def _m5a(t):
    doomed = t.food_listings.where(F.col("Expiry_Date") < F.lit(CUTOFF)).select("Food_ID")
    return CH.delete_rows(t.as_dict(), "food_listings", doomed)["claims"]


_LISTING_COLS = ", ".join(f.name for f in SCHEMAS["food_listings"].fields)


@register(
    "delete_providers_set_null",
    _LISTING_COLS.replace(
        "Provider_ID",
        "CASE WHEN Provider_ID IN (SELECT Provider_ID FROM providers WHERE Type = 'AFRICA') "
        "THEN NULL ELSE Provider_ID END AS Provider_ID",
    ).join(["SELECT ", " FROM food_listings"]),
)
def _m5b(t):
    doomed = t.providers.where(F.col("Type") == "AFRICA").select("Provider_ID")
    return CH.delete_rows(t.as_dict(), "providers", doomed)["food_listings"]


@register(
    "delete_receivers_set_null",
    """SELECT Claim_ID, Food_ID,
              CASE WHEN Receiver_ID IN (SELECT Receiver_ID FROM receivers WHERE Type = 'BUILDING')
                   THEN NULL ELSE Receiver_ID END AS Receiver_ID, Status, Timestamp
       FROM claims""",
)
def _m5c(t):
    doomed = t.receivers.where(F.col("Type") == "BUILDING").select("Receiver_ID")
    return CH.delete_rows(t.as_dict(), "receivers", doomed)["claims"]


@register(
    "complete_old_open_claims",
    f"""SELECT Claim_ID, Food_ID, Receiver_ID,
               CASE WHEN Claim_ID IN (
                      SELECT c.Claim_ID FROM claims c
                      JOIN food_listings f ON c.Food_ID = f.Food_ID
                      JOIN receivers r ON c.Receiver_ID = r.Receiver_ID
                      WHERE c.Status <> 'Completed' AND c.Timestamp < {CUTOFF_SQL})
                    THEN 'Completed' ELSE Status END AS Status,
               Timestamp
        FROM claims""",
)
def _m4(t):
    # The pick-list of open claims (F9), restricted to old ones before the
    # joins, then marked Completed (M4).
    old = t.claims.where(F.col("Timestamp") < F.lit(CUTOFF))
    picked = FL.open_claims(old, t.food_listings, t.receivers).select("Claim_ID")
    return CH.complete_claims(t.claims, picked)


@register(
    "update_listings_batch",
    """SELECT Food_ID, Food_Name,
              CASE WHEN Food_Type = 'PROMO' THEN Quantity * 2 ELSE Quantity END AS Quantity,
              CASE WHEN Meal_Type = 'Brand#3' THEN NULL ELSE Expiry_Date END AS Expiry_Date,
              Provider_ID, Provider_Type,
              CASE WHEN Food_Type = 'PROMO' THEN 'Depot ' || Location ELSE Location END AS Location,
              Food_Type, Meal_Type
       FROM food_listings""",
)
def _m3(t):
    lst = t.food_listings
    promo = lst.where(F.col("Food_Type") == "PROMO")
    batch = (
        promo.select(F.lit("U").alias("op"), F.lit(1).cast("bigint").alias("seq"), "Food_ID",
                     F.array(F.lit("Quantity")).alias("set"), (F.col("Quantity") + 5).alias("Quantity"),
                     F.lit(None).cast("date").alias("Expiry_Date"), F.lit(None).cast("string").alias("Location"))
        .unionByName(promo.select(F.lit("U").alias("op"), F.lit(2).cast("bigint").alias("seq"), "Food_ID",
                                  F.array(F.lit("Quantity"), F.lit("Location")).alias("set"),
                                  (F.col("Quantity") * 2).alias("Quantity"), F.lit(None).cast("date").alias("Expiry_Date"),
                                  F.concat(F.lit("Depot "), F.col("Location")).alias("Location")))
        .unionByName(lst.where(F.col("Meal_Type") == "Brand#3").select(
            F.lit("U").alias("op"), F.lit(3).cast("bigint").alias("seq"), "Food_ID",
            F.array(F.lit("Expiry_Date")).alias("set"), F.lit(None).cast("int").alias("Quantity"),
            F.lit(None).cast("date").alias("Expiry_Date"), F.lit(None).cast("string").alias("Location")))
        # Updates of keys that do not exist change nothing.
        .unionByName(lst.where(F.col("Food_Type") == "ECONOMY").select(
            F.lit("U").alias("op"), F.lit(4).cast("bigint").alias("seq"),
            (F.col("Food_ID") + F.lit(10**12)).alias("Food_ID"), F.array(F.lit("Quantity")).alias("set"),
            F.lit(0).alias("Quantity"), F.lit(None).cast("date").alias("Expiry_Date"),
            F.lit(None).cast("string").alias("Location")))
    )
    return CH.update_rows(lst, batch, "food_listings", ["Quantity", "Expiry_Date", "Location"])


@register(
    "insert_reclaims",
    f"""SELECT * FROM claims
        UNION ALL
        SELECT (SELECT MAX(Claim_ID) FROM claims) + row_number() OVER (ORDER BY Claim_ID) AS Claim_ID,
               Food_ID, Receiver_ID, 'Pending' AS Status,
               CAST({"DATE '1998-06-01'"} AS TIMESTAMP) AS Timestamp
        FROM claims WHERE Status = 'Cancelled'""",
)
def _m1(t):
    c = t.claims
    new = c.where(F.col("Status") == "Cancelled").select(
        F.col("Claim_ID").alias("_old_id"), "Food_ID", "Receiver_ID", F.lit("Pending").alias("Status"),
        # date -> timestamp_ntz is midnight in every session time zone
        F.lit(AS_OF).cast("timestamp_ntz").alias("Timestamp"),
    )
    return CH.insert_rows(c, new, "claims", order_cols=["_old_id"])


@register(
    "rekey_providers",
    _LISTING_COLS.replace(
        "Provider_ID",
        "CASE WHEN Provider_ID IN (SELECT Provider_ID FROM providers WHERE City = 'NATION_3') "
        "THEN Provider_ID + 1000000 ELSE Provider_ID END AS Provider_ID",
    ).join(["SELECT ", " FROM food_listings"]),
)
def _m6(t):
    mapping = t.providers.where(F.col("City") == "NATION_3").select(
        F.col("Provider_ID").alias("old_id"), (F.col("Provider_ID") + 1000000).alias("new_id")
    )
    return CH.rekey_rows(t.as_dict(), "providers", mapping)["food_listings"]


# --- A: sources and SQL entry point ---------------------------------------------------------

@register(
    "csv_roundtrip_providers",
    f"""SELECT Provider_ID, {ct('Name')} AS Name, {ct('Type')} AS Type, {ca('Address')} AS Address,
               {ct('City')} AS City, {dg('Contact')} AS Contact FROM providers""",
)
def _a1(t):
    # A5 write (CSV with header) into the shared checkpoint folder, then A1
    # read (multi-line, quoted, NA tokens -> null) and the providers cleaner.
    path = scratch_path(t.spark, "providers_csv")
    write_csv(t.providers, path)
    return CL.clean_providers(read_table_csv(t.spark, path, "providers"))


@register(
    "sql_receivers_by_city_param",
    """SELECT City, COUNT(*) AS Total_Receivers FROM receivers
       WHERE Type = 'BUILDING' AND Name ILIKE '%customer#000%' GROUP BY City""",
)
def _a3(t):
    return run_query(
        t.spark,
        "SELECT City, COUNT(*) AS Total_Receivers FROM larder_receivers "
        "WHERE Type = :seg AND Name ILIKE :name GROUP BY City",
        {"seg": "BUILDING", "name": "%customer#000%"},
        {"larder_receivers": t.receivers},
    )
