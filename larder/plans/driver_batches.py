"""Registered batches over several tables: references, replay, key changes.

The changes are derived from the whole tables by key remainders; the oracles say
from the remainders what must become of every row and apply nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import referential as RF
from larder.operators import rekey as RK
from larder.plans.registry import register
from larder.session import written
from larder.sources.driver import DriverTables

#: New keys lie this far above the keys they are made of; phases of a batch further apart.
N = 10**9
PHASE = 10**13


def rest(column: str, n: int, r: int) -> Column:
    """Whether ``column`` leaves remainder ``r``; null does not."""
    return F.coalesce(F.pmod(F.col(column), F.lit(n)) == r, F.lit(False))


def change(op: str, phase: int, key: Column, assigned: tuple[str, ...], **values: Column) -> Column:
    names = F.array(*[F.lit(c) for c in assigned]) if assigned else F.array().cast("array<string>")
    return F.struct(
        F.lit(op).alias("op"), (key + phase * PHASE).cast("bigint").alias("seq"), key.cast("bigint").alias("key"), names.alias("set"),
        *[v.alias(c) for c, v in values.items()],
    )


def exploded(rows: DataFrame, key: str, *choices: tuple[Column, Column]) -> DataFrame:
    """One pass: a row gives, side by side, the changes whose condition it meets."""
    listed = F.filter(F.array(*[F.when(when, what) for when, what in choices]), lambda x: x.isNotNull())
    return rows.select(F.explode(listed).alias("c")).select("c.*").withColumnRenamed("key", key)


def once(t) -> DriverTables:
    """``t`` with listings and claims written once: every step of a batch reads
    them, and each reading of the adapter's views aggregates all line items."""
    frames = t.as_dict()
    listings, claims = (written(frames[n], n) for n in ("food_listings", "claims"))
    return DriverTables(t.spark, t.sf_dir).use(frames | {"food_listings": listings, "claims": claims})


def linked_batch(t) -> dict[str, DataFrame]:
    """Changes of listings (even phases) and of claims on them (odd phases).

    Listings: every 5th is entered anew, every 3rd of those for a provider that
    is not there; 3 mod 7 is deleted, half of it entered again; new ones of even
    keys are deleted.  Claims come before, between and after those changes.
    """
    f, c, none = F.col("Food_ID"), F.col("Claim_ID"), F.lit(None).cast("bigint")
    provider = F.when(rest("Food_ID", 15, 0), F.lit(10**12)).otherwise(F.col("Provider_ID"))

    def listing(op: str, phase: int, key: Column, name: str | None = None, quantity: Column | None = None, ref: Column = none) -> Column:
        quantity = F.lit(None).cast("int") if quantity is None else quantity
        return change(op, phase, key, (), Food_Name=F.lit(name).cast("string"), Quantity=quantity, Provider_ID=ref.cast("bigint"))

    listings = exploded(
        t.food_listings, "Food_ID",
        (rest("Food_ID", 5, 0), listing("I", 2, f + N, "new", F.col("Quantity"), provider)),
        (rest("Food_ID", 7, 3), listing("D", 4, f)),
        (rest("Food_ID", 10, 0), listing("D", 4, f + N)),
        (rest("Food_ID", 14, 3), listing("I", 6, f, "again")),
    )

    def claim(op: str, phase: int, key: Column, status: str, food: Column, assigned: tuple[str, ...] = (), receiver: Column | None = None) -> Column:
        receiver = F.col("Receiver_ID") if receiver is None else receiver
        return change(op, phase, key, assigned, Status=F.lit(status), Food_ID=food.cast("bigint"), Receiver_ID=receiver)

    fifth, gone = rest("Food_ID", 5, 0), rest("Food_ID", 7, 3)
    claims = exploded(
        t.claims, "Claim_ID",
        (fifth, claim("I", 1, c + N, "too early", f + N)),
        (fifth, claim("I", 3, c + 2 * N, "new", f + N)),
        (gone & rest("Claim_ID", 2, 0), claim("U", 3, c, "", none, ("Food_ID",))),
        (gone, claim("I", 5, c + 3 * N, "too late", f)),
        (gone & rest("Claim_ID", 2, 1), claim("U", 5, c, "no row", none, ("Status", "Food_ID"))),
        (fifth & ~gone & rest("Claim_ID", 3, 0), claim("U", 5, c, "moved", f + N, ("Status", "Food_ID"))),
        (rest("Food_ID", 14, 3), claim("I", 7, c + 4 * N, "second", f)),
        (rest("Claim_ID", 4, 1), claim("I", 7, c, "again", none, (), none)),
    )
    return {"food_listings": listings, "claims": claims}


_GONE = "coalesce(Food_ID % 7 = 3, false)"
_NEW_LISTING = "Food_ID % 5 = 0 AND Food_ID % 15 <> 0 AND Food_ID % 10 <> 0"


@register(
    "linked_batch_claims",
    f"""SELECT Claim_ID,
               CASE WHEN {_GONE} THEN NULL WHEN {_NEW_LISTING} AND Claim_ID % 3 = 0 THEN Food_ID + {N} ELSE Food_ID END AS Food_ID,
               Receiver_ID, CASE WHEN NOT {_GONE} AND {_NEW_LISTING} AND Claim_ID % 3 = 0 THEN 'moved' ELSE Status END AS Status, Timestamp
        FROM claims WHERE NOT ({_GONE} AND Claim_ID % 2 = 1)
        UNION ALL SELECT Claim_ID, NULL, NULL, 'again', NULL FROM claims WHERE {_GONE} AND Claim_ID % 4 = 1
        UNION ALL SELECT Claim_ID + {2 * N}, Food_ID + {N}, Receiver_ID, 'new', NULL FROM claims WHERE {_NEW_LISTING}
        UNION ALL SELECT Claim_ID + {4 * N}, Food_ID, Receiver_ID, 'second', NULL FROM claims WHERE Food_ID % 14 = 3""",
)
def _linked_claims(t):
    t = once(t)
    return RF.apply_batch(t.as_dict(), linked_batch(t))[0]["claims"]


@register(
    "linked_batch_listings",
    f"""SELECT * FROM food_listings WHERE Food_ID % 7 <> 3
        UNION ALL SELECT Food_ID, 'again', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM food_listings WHERE Food_ID % 14 = 3
        UNION ALL SELECT Food_ID + {N}, 'new', Quantity, NULL, Provider_ID, NULL, NULL, NULL, NULL FROM food_listings WHERE {_NEW_LISTING}""",
)
def _linked_listings(t):
    t = once(t)
    return RF.apply_batch(t.as_dict(), linked_batch(t))[0]["food_listings"]


_NO_LISTING = "'Food_ID has no food_listings row'"


@register(
    "linked_batch_rejected",
    f"""SELECT table_name, key_value, key_value + phase * CAST({PHASE} AS BIGINT) AS seq, reason FROM (
          SELECT 'food_listings' AS table_name, Food_ID + {N} AS key_value, 2 AS phase, 'Provider_ID has no providers row' AS reason
          FROM food_listings WHERE Food_ID % 15 = 0
          UNION ALL SELECT 'claims', Claim_ID + {N}, 1, {_NO_LISTING} FROM claims WHERE Food_ID % 5 = 0
          UNION ALL SELECT 'claims', Claim_ID + {2 * N}, 3, {_NO_LISTING} FROM claims WHERE Food_ID % 15 = 0
          UNION ALL SELECT 'claims', Claim_ID + {3 * N}, 5, {_NO_LISTING} FROM claims WHERE Food_ID % 7 = 3
          UNION ALL SELECT 'claims', Claim_ID, 5, {_NO_LISTING} FROM claims
            WHERE Food_ID % 5 = 0 AND Food_ID % 7 <> 3 AND Claim_ID % 3 = 0 AND (Food_ID % 15 = 0 OR Food_ID % 10 = 0)
          UNION ALL SELECT 'claims', Claim_ID, 7, 'key is taken' FROM claims WHERE Claim_ID % 4 = 1 AND NOT {_GONE})""",
)
def _linked_rejected(t):
    t = once(t)
    return RF.apply_batch(t.as_dict(), linked_batch(t))[1]


# --- M1-M5: a batch given twice -----------------------------------------------------------


def repeated_batch(receivers: DataFrame) -> DataFrame:
    """Per key: an update before its insert; inserts without a key; deletes; a rename."""
    r = F.col("Receiver_ID")

    def one(op: str, phase: int, key: Column, name: str, assigned: tuple[str, ...] = ()) -> Column:
        return change(op, phase, key, assigned, Name=F.lit(name), City=F.lit("here"))

    told = exploded(
        receivers, "Receiver_ID",
        (rest("Receiver_ID", 4, 1), one("U", 1, r + N, "early", ("Name",))),
        (rest("Receiver_ID", 4, 1), one("I", 2, r + N, "new")),
        (rest("Receiver_ID", 4, 2), one("I", 3, r, "unnamed")),
        (rest("Receiver_ID", 4, 3), one("D", 4, r, "")),
        (rest("Receiver_ID", 4, 0), one("U", 5, r, "named", ("Name",))),
    )
    unnamed = (F.col("op") == "I") & (F.col("Name") == "unnamed")
    return told.withColumn("Receiver_ID", F.when(~unnamed, F.col("Receiver_ID")))


@register(
    "changes_applied_twice",
    f"""SELECT Receiver_ID, CASE WHEN Receiver_ID % 4 = 0 THEN 'named' ELSE Name END AS Name, Type, City, Contact
        FROM receivers WHERE Receiver_ID % 4 <> 3
        UNION ALL SELECT Receiver_ID + {N}, 'new', NULL, 'here', NULL FROM receivers WHERE Receiver_ID % 4 = 1
        UNION ALL
        SELECT (SELECT max(Receiver_ID) + {N} FROM receivers WHERE Receiver_ID % 4 = 1) + row_number() OVER (ORDER BY Receiver_ID),
               'unnamed', NULL, 'here', NULL FROM receivers WHERE Receiver_ID % 4 = 2""",
)
def _twice(t):
    batch = {"receivers": repeated_batch(t.receivers)}
    once, _, ledgers = RF.apply_once({"receivers": t.receivers}, batch, {})
    return RF.apply_once(once, batch, ledgers)[0]["receivers"]


# --- M6: moves in sequence ------------------------------------------------------------------


def provider_moves(providers: DataFrame) -> DataFrame:
    """By the key's remainder of 10: 0 a chain, 1 and 2 a swap by way of a free
    key, 3 two moves of one row, 4 to a taken key, 6 to a key that 7 leaves only
    later, 8 there and back."""
    a = F.col("Provider_ID")
    moves = {
        0: [(1, a, a + N), (2, a + N, a + 2 * N)],
        1: [(1, a, a + 3 * N), (2, a + 1, a), (3, a + 3 * N, a + 1)],
        3: [(1, a, a + 4 * N), (2, a, a + 5 * N)],
        4: [(1, a, a + 1)],
        6: [(1, a, a + 1), (3, a, a + 1)],
        7: [(2, a, a + 6 * N)],
        8: [(1, a, a + 7 * N), (2, a + 7 * N, a)],
    }
    listed = F.array().cast("array<struct<seq:bigint,old_id:bigint,new_id:bigint>>")
    for r, steps in moves.items():
        told = F.array(*[F.struct(F.lit(s).cast("bigint").alias("seq"), x.alias("old_id"), y.alias("new_id")) for s, x, y in steps])
        listed = F.when(rest("Provider_ID", 10, r), told).otherwise(listed)
    return providers.select(F.explode(listed).alias("m")).select("m.*")


_NEXT = "EXISTS (SELECT 1 FROM providers q WHERE q.Provider_ID = p.Provider_ID + 1)"
_PLACES = f""", places AS (
  SELECT Provider_ID AS old_id, CASE Provider_ID % 10
           WHEN 0 THEN Provider_ID + {2 * N} WHEN 1 THEN Provider_ID + 1
           WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM providers q WHERE q.Provider_ID = p.Provider_ID - 1) THEN Provider_ID - 1 ELSE Provider_ID END
           WHEN 3 THEN Provider_ID + {4 * N} WHEN 4 THEN CASE WHEN {_NEXT} THEN Provider_ID ELSE Provider_ID + 1 END
           WHEN 6 THEN Provider_ID + 1 WHEN 7 THEN Provider_ID + {6 * N} ELSE Provider_ID END AS new_id
  FROM providers p)
"""


def _moved(t) -> dict[str, DataFrame]:
    mapping, _ = RK.compose_moves(t.providers.select("Provider_ID"), provider_moves(t.providers))
    return CH.rekey_rows(t.as_dict(), "providers", mapping)


@register(
    "rekey_moves_providers",
    _PLACES + "SELECT new_id AS Provider_ID, Name, Type, Address, City, Contact FROM providers JOIN places ON Provider_ID = old_id",
)
def _moved_providers(t):
    return _moved(t)["providers"]


@register(
    "rekey_moves_listings",
    _PLACES + "SELECT f.* REPLACE (coalesce(new_id, Provider_ID) AS Provider_ID) FROM food_listings f LEFT JOIN places ON Provider_ID = old_id",
)
def _moved_listings(t):
    # ``rekey_rows`` leaves a reference to a provider that is not there as it is.
    return _moved(t)["food_listings"]


@register(
    "rekey_moves_rejected",
    f"""SELECT CAST(seq AS BIGINT) AS seq, old_id, new_id, reason FROM (
          SELECT 2 AS seq, Provider_ID + 1 AS old_id, Provider_ID AS new_id, 'no row has old_id' AS reason
          FROM providers p WHERE Provider_ID % 10 = 1 AND NOT {_NEXT}
          UNION ALL SELECT 2, Provider_ID, Provider_ID + {5 * N}, 'no row has old_id' FROM providers WHERE Provider_ID % 10 = 3
          UNION ALL SELECT 1, Provider_ID, Provider_ID + 1, 'new_id is taken' FROM providers p WHERE Provider_ID % 10 IN (4, 6) AND {_NEXT}
          UNION ALL SELECT 3, Provider_ID, Provider_ID + 1, 'no row has old_id' FROM providers p WHERE Provider_ID % 10 = 6 AND NOT {_NEXT})""",
)
def _moves_rejected(t):
    return RK.compose_moves(t.providers.select("Provider_ID"), provider_moves(t.providers))[1]
