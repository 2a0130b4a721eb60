"""The four tables of the donation/claims model, as data.

Column names, declared lengths and foreign-key actions are fixed values of the
data model (they must equal the original DDL for results to line up); they are
kept together here so that cleaning, audits and change jobs read them from one
place instead of repeating literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: table schemas (column, Spark type) in declared order ------
PROVIDERS = T.StructType(
    [
        T.StructField("Provider_ID", T.LongType(), False),
        T.StructField("Name", T.StringType(), True),
        T.StructField("Type", T.StringType(), True),
        T.StructField("Address", T.StringType(), True),
        T.StructField("City", T.StringType(), True),
        T.StructField("Contact", T.StringType(), True),
    ]
)

RECEIVERS = T.StructType(
    [
        T.StructField("Receiver_ID", T.LongType(), False),
        T.StructField("Name", T.StringType(), True),
        T.StructField("Type", T.StringType(), True),
        T.StructField("City", T.StringType(), True),
        T.StructField("Contact", T.StringType(), True),
    ]
)

FOOD_LISTINGS = T.StructType(
    [
        T.StructField("Food_ID", T.LongType(), False),
        T.StructField("Food_Name", T.StringType(), True),
        T.StructField("Quantity", T.IntegerType(), True),
        T.StructField("Expiry_Date", T.DateType(), True),
        T.StructField("Provider_ID", T.LongType(), True),
        T.StructField("Provider_Type", T.StringType(), True),
        T.StructField("Location", T.StringType(), True),
        T.StructField("Food_Type", T.StringType(), True),
        T.StructField("Meal_Type", T.StringType(), True),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("Claim_ID", T.LongType(), False),
        T.StructField("Food_ID", T.LongType(), True),
        T.StructField("Receiver_ID", T.LongType(), True),
        T.StructField("Status", T.StringType(), True),
        T.StructField("Timestamp", T.TimestampNTZType(), True),
    ]
)

SCHEMAS: dict[str, T.StructType] = {
    "providers": PROVIDERS,
    "receivers": RECEIVERS,
    "food_listings": FOOD_LISTINGS,
    "claims": CLAIMS,
}

PRIMARY_KEYS: dict[str, str] = {
    "providers": "Provider_ID",
    "receivers": "Receiver_ID",
    "food_listings": "Food_ID",
    "claims": "Claim_ID",
}

# --- fixed values: declared VARCHAR lengths ----------------------------------
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "providers": {"Name": 255, "Type": 100, "City": 100, "Contact": 50},
    "receivers": {"Name": 255, "Type": 100, "City": 100, "Contact": 50},
    "food_listings": {
        "Food_Name": 255,
        "Provider_Type": 100,
        "Location": 255,
        "Food_Type": 100,
        "Meal_Type": 100,
    },
    "claims": {"Status": 50},
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # "cascade" | "set_null"
    on_update: str  # "cascade"


# --- fixed values: foreign keys and their referential actions ---------------
FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("food_listings", "Provider_ID", "providers", "set_null", "cascade"),
    ForeignKey("claims", "Food_ID", "food_listings", "cascade", "cascade"),
    ForeignKey("claims", "Receiver_ID", "receivers", "set_null", "cascade"),
)

# Parents before children: the order in which tables are loaded.
LOAD_ORDER: tuple[str, ...] = ("providers", "receivers", "food_listings", "claims")


def children_of(table: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == table]


def parents_of(table: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.child == table]


def ddl(table: str) -> str:
    """Spark DDL column list (``name type, ...``) for ``CREATE TABLE``."""
    return ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table].fields
    )
