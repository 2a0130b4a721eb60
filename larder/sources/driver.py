"""Adapter: the driver's TPC-H-like tables -> the four donation/claims tables.

Mapping (see FIXTURES.md section 3):

* providers     <- supplier (+ nation, region): ID, name, region as Type, nation as City,
  Address and Contact made of the key
* receivers     <- customer (+ nation): ID, name, market segment as Type, nation as City,
  Contact made of the key
* food_listings <- part + its first lineitem (least (orderkey, linenumber,
  suppkey, shipdate)): supplier is the provider, ship date the expiry
* claims        <- orders + its first lineitem (least (linenumber, partkey,
  suppkey, shipdate)): that line's part is the claimed listing

Scale notes.  ``lineitem`` is the only large input.  The "first line" per part
and per order is an aggregate (``min`` of a struct) rather than a
``row_number()`` window: it combines map-side, so a part or order holding a
third of all lines collapses to one row per map task before the shuffle, and
because the right side is unique by its grouping key Catalyst removes the
whole lineitem branch when a query does not use its columns.  No broadcast is
forced anywhere; nation/region are tiny files and Spark's size check picks a
broadcast for them on its own, while supplier/customer/part grow with the
data and are joined by whatever AQE measures at run time.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: order status code -> claim status -------------------------
STATUS_BY_CODE = {"F": "Completed", "O": "Pending", "P": "Cancelled"}


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_driver(spark, sf_dir, "nation")
    region = read_driver(spark, sf_dir, "region")
    return nation.join(
        region, nation.n_regionkey == region.r_regionkey, "left"
    ).select("n_nationkey", "n_name", "r_name")


def contact(key: str):
    """A phone number made of the key; every seventh party has none."""
    k = F.col(key).cast("bigint")
    number = F.concat(F.lit("+"), (k % 90 + 10).cast("string"), F.lit(" (555) "), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("-x"))
    return F.when(k % 7 != 0, number)


def address(key: str, city: str):
    """A street address of two lines with stray spaces; every fifth provider has none."""
    k = F.col(key).cast("bigint")
    text = F.concat(F.lit("  No. "), k.cast("string"), F.lit(",\n Main  Street\t"), F.coalesce(F.col(city), F.lit("?")))
    return F.when(k % 5 != 0, text)


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_driver(spark, sf_dir, "supplier")
    geo = _nation_region(spark, sf_dir)
    return supplier.join(geo, supplier.s_nationkey == geo.n_nationkey, "left").select(
        F.col("s_suppkey").cast("bigint").alias("Provider_ID"),
        F.col("s_name").alias("Name"),
        F.col("r_name").alias("Type"),
        address("s_suppkey", "n_name").alias("Address"),
        F.col("n_name").alias("City"),
        contact("s_suppkey").alias("Contact"),
    )


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_driver(spark, sf_dir, "customer")
    nation = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").cast("bigint").alias("Receiver_ID"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Type"),
        F.col("n_name").alias("City"),
        contact("c_custkey").alias("Contact"),
    )


def first_line_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, l_suppkey, l_shipdate) of the least line per part."""
    li = read_driver(spark, sf_dir, "lineitem")
    first = li.groupBy("l_partkey").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")).alias("f")
    )
    return first.select("l_partkey", F.col("f.l_suppkey").alias("l_suppkey"),
                        F.col("f.l_shipdate").alias("l_shipdate"))


#: Part keys lie below this bound (10^18), line numbers below 10^19; together they
#: fill a decimal(38,0), the widest value a hash aggregate keeps in place.
_PART_RANGE = 10**18
_SHIFT = Decimal(10**19)


def first_line_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey) of the least line per order.

    Only the part is wanted, so the least (line number, part key) decides and
    the two are packed into one number, line number first: the minimum of a
    number is hash-aggregated, that of a struct would sort every map task's
    lines.  Part keys must lie in [0, 10^18); a key outside fails the job.
    """
    li = read_driver(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("bigint")
    fits = part.isNull() | ((part >= 0) & (part < F.lit(_PART_RANGE)))
    # A null part sorts first among the lines of one number, as it does in a struct.
    low = F.when(fits, F.coalesce(part + 1, F.lit(0)).cast("decimal(19,0)")).otherwise(
        F.raise_error(F.lit("l_partkey out of range")).cast("decimal(19,0)")
    )
    packed = F.col("l_linenumber").cast("decimal(18,0)") * F.lit(_SHIFT) + low
    first = li.groupBy("l_orderkey").agg(F.min(packed.cast("decimal(38,0)")).alias("f"))
    part_of = (F.col("f") % F.lit(_SHIFT)).cast("bigint")
    return first.select("l_orderkey", F.when(part_of > 0, part_of - 1).alias("l_partkey"))


def food_listings(spark: SparkSession, sf_dir: str, provider_df: DataFrame | None = None) -> DataFrame:
    part = read_driver(spark, sf_dir, "part")
    first = first_line_per_part(spark, sf_dir)
    # Grouped by its key, the provider side is known to be unique: Catalyst drops
    # the join (and the shuffle on a possibly hot supplier) where no column of it
    # is used.
    prov = (provider_df if provider_df is not None else providers(spark, sf_dir)).groupBy(
        F.col("Provider_ID").alias("_pid")
    ).agg(F.min(F.struct("Type", "City")).alias("_p")).select(
        "_pid", F.col("_p.Type").alias("_ptype"), F.col("_p.City").alias("_pcity")
    )
    listed = part.join(first, part.p_partkey == first.l_partkey, "left")
    return listed.join(prov, listed.l_suppkey == prov._pid, "left").select(
        F.col("p_partkey").cast("bigint").alias("Food_ID"),
        F.col("p_name").alias("Food_Name"),
        F.col("p_size").cast("int").alias("Quantity"),
        F.col("l_shipdate").cast("date").alias("Expiry_Date"),
        F.col("l_suppkey").cast("bigint").alias("Provider_ID"),
        F.col("_ptype").alias("Provider_Type"),
        F.col("_pcity").alias("Location"),
        F.col("p_type").alias("Food_Type"),
        F.col("p_brand").alias("Meal_Type"),
    )


def status_from_code(code):
    expr = F.when(code.isNull(), F.lit(None).cast("string"))
    for k, v in STATUS_BY_CODE.items():
        expr = expr.when(code == k, F.lit(v))
    return expr.otherwise(code)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_driver(spark, sf_dir, "orders")
    first = first_line_per_order(spark, sf_dir)
    return orders.join(first, orders.o_orderkey == first.l_orderkey, "left").select(
        F.col("o_orderkey").cast("bigint").alias("Claim_ID"),
        F.col("l_partkey").cast("bigint").alias("Food_ID"),
        F.col("o_custkey").cast("bigint").alias("Receiver_ID"),
        status_from_code(F.col("o_orderstatus")).alias("Status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("Timestamp"),
    )


class DriverTables:
    """Lazily built views over one driver scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def providers(self) -> DataFrame:
        return self._get("providers", lambda: providers(self.spark, self.sf_dir))

    @property
    def receivers(self) -> DataFrame:
        return self._get("receivers", lambda: receivers(self.spark, self.sf_dir))

    @property
    def food_listings(self) -> DataFrame:
        return self._get("food_listings", lambda: food_listings(self.spark, self.sf_dir))

    @property
    def claims(self) -> DataFrame:
        return self._get("claims", lambda: claims(self.spark, self.sf_dir))

    def use(self, frames: dict[str, DataFrame]) -> "DriverTables":
        """Serve these frames (e.g. a loaded parquet version) instead of
        rebuilding the tables from the driver files."""
        self._cache.update(frames)
        return self

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "providers": self.providers,
            "receivers": self.receivers,
            "food_listings": self.food_listings,
            "claims": self.claims,
        }

    def register_views(self) -> None:
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)


# DuckDB text of the same mapping, prepended to every oracle query.
ORACLE_VIEWS_SQL = """
WITH providers AS (
  SELECT CAST(s.s_suppkey AS BIGINT) AS Provider_ID, s.s_name AS Name, r.r_name AS Type,
         CASE WHEN s.s_suppkey % 5 <> 0 THEN
           '  No. ' || CAST(s.s_suppkey AS VARCHAR) || ',' || chr(10) || ' Main  Street' || chr(9) || coalesce(n.n_name, '?') END AS Address,
         n.n_name AS City,
         CASE WHEN s.s_suppkey % 7 <> 0 THEN
           '+' || CAST(s.s_suppkey % 90 + 10 AS VARCHAR) || ' (555) ' || lpad(CAST(s.s_suppkey % 100000 AS VARCHAR), 5, '0') || '-x' END AS Contact
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
receivers AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS Receiver_ID, c.c_name AS Name, c.c_mktsegment AS Type,
         n.n_name AS City,
         CASE WHEN c.c_custkey % 7 <> 0 THEN
           '+' || CAST(c.c_custkey % 90 + 10 AS VARCHAR) || ' (555) ' || lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') || '-x' END AS Contact
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
part_first AS (
  SELECT l_partkey, l_suppkey, l_shipdate FROM (
    SELECT l_partkey, l_suppkey, l_shipdate,
           row_number() OVER (PARTITION BY l_partkey
                              ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS rn
    FROM lineitem) t WHERE rn = 1
),
food_listings AS (
  SELECT CAST(p.p_partkey AS BIGINT) AS Food_ID, p.p_name AS Food_Name,
         CAST(p.p_size AS INTEGER) AS Quantity, CAST(pf.l_shipdate AS DATE) AS Expiry_Date,
         CAST(pf.l_suppkey AS BIGINT) AS Provider_ID, pr.Type AS Provider_Type,
         pr.City AS Location, p.p_type AS Food_Type, p.p_brand AS Meal_Type
  FROM part p
  LEFT JOIN part_first pf ON p.p_partkey = pf.l_partkey
  LEFT JOIN providers pr ON pf.l_suppkey = pr.Provider_ID
),
order_first AS (
  SELECT l_orderkey, l_partkey FROM (
    SELECT l_orderkey, l_partkey,
           row_number() OVER (PARTITION BY l_orderkey
                              ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn
    FROM lineitem) t WHERE rn = 1
),
claims AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS Claim_ID, CAST(ofl.l_partkey AS BIGINT) AS Food_ID,
         CAST(o.o_custkey AS BIGINT) AS Receiver_ID,
         CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending'
              WHEN 'P' THEN 'Cancelled' ELSE o.o_orderstatus END AS Status,
         CAST(o.o_orderdate AS TIMESTAMP) AS Timestamp
  FROM orders o LEFT JOIN order_first ofl ON o.o_orderkey = ofl.l_orderkey
)
"""
