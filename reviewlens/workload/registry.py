"""Query registry and the views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


class Source:
    """Tables of one data directory by attribute."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.directory}/{name}.parquet"
        if name in ("documents", "pages", "conversations"):
            return files.read_texts(self.spark, path)
        return self.spark.read.parquet(path)


def query(name: str, sql: str | None = None):
    """Register a function of `Source`, with its SQL when there is one."""

    def register(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, directory: build(Source(spark, directory))
        MODULES[name] = build.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def near(a, b, tolerance: float = 1e-6):
    """Whether two numbers agree, for results that SQL can only state as a property."""
    return F.abs(a - b) < tolerance


# --- ratings: one review per order line ------------------------------------------------------

REVIEW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def rated(t: Source) -> DataFrame:
    df = t.lineitem.select(
        *REVIEW_KEY, "l_shipdate", "l_returnflag", "l_quantity",
        F.when(F.col("l_linenumber") < 7, (1 + F.col("l_linenumber") % 5).cast("double")).alias("Effectiveness"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("EaseOfUse"),
        (1 + F.rint(F.col("l_discount") * 100).cast("int") % 5).cast("double").alias("Satisfaction"),
        c.round_half_even(F.col("l_tax") * 25 - 1).alias("bert_compound"),
        c.round_half_even(F.col("l_discount") * 5).alias("bert_neg"),
        c.round_half_even(F.col("l_tax") * 5).alias("bert_pos"),
        c.round_half_even(F.col("l_quantity") / 100).alias("bert_neu"),
        F.when(F.col("l_returnflag") == "A", "Male").when(F.col("l_returnflag") == "N", "Female").alias("Gender"),
    )
    return df.withColumn("Overall", c.row_mean_strict("Effectiveness", "EaseOfUse", "Satisfaction"))


RATED = """
line AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, l_quantity,
         CASE WHEN l_linenumber < 7 THEN CAST(1 + l_linenumber % 5 AS DOUBLE) END AS Effectiveness,
         CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS DOUBLE) AS EaseOfUse,
         CAST(1 + CAST(round(l_discount * 100) AS INTEGER) % 5 AS DOUBLE) AS Satisfaction,
         round(l_tax * 25 - 1, 2) AS bert_compound,
         round(l_discount * 5, 2) AS bert_neg,
         round(l_tax * 5, 2) AS bert_pos,
         round(l_quantity / 100, 2) AS bert_neu,
         CASE l_returnflag WHEN 'A' THEN 'Male' WHEN 'N' THEN 'Female' END AS Gender
  FROM lineitem),
rated AS (SELECT *, (Effectiveness + EaseOfUse + Satisfaction) / 3 AS Overall FROM line)
"""


def reviews(t: Source) -> DataFrame:
    """Rated lines with family, drug, condition, age and duration from the joined tables."""
    part = t.part.select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("DrugFamily"),
        F.col("p_name").alias("Drug"), F.col("p_brand").alias("Condition"),
    )
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("Age"))
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("TimeUsingDrug"))
    return rated(t).join(part, "l_partkey").join(orders, "l_orderkey").join(customer, "o_custkey")


REVIEWS = (
    RATED
    + """,
reviews AS (
  SELECT rated.*, p_type AS DrugFamily, p_name AS Drug, p_brand AS Condition,
         o_orderpriority AS Age, c_mktsegment AS TimeUsingDrug
  FROM rated JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)
"""
)


def rated_by_family(t: Source) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("DrugFamily"))
    return rated(t).join(part, "l_partkey")


RATED_BY_FAMILY = RATED + """,
family AS (SELECT rated.*, p_type AS DrugFamily FROM rated JOIN part ON l_partkey = p_partkey)
"""

# --- documents with a sentiment from their labels --------------------------------------------


def labelled(t: Source) -> DataFrame:
    """Documents with the label rows that exist, family and sentiment."""
    docs = t.documents.join(t.labels, "doc_id", "left")
    return docs.withColumn("DrugFamily", F.col("lang")).withColumn(
        "bert_compound_threshold",
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral"),
    )


LABELLED = """
labelled AS (
  SELECT d.*, quality, toxic, lang AS DrugFamily,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END
           AS bert_compound_threshold
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

# --- a dictionary for part names -------------------------------------------------------------

PART_FAMILIES = {
    "FLAT": ["plate", "anvil"],
    "ROUND": ["ring", "gear", "rod"],
    "SMALL": ["small", "bolt"],
    "OTHER": ["hot gizmo", "gizmo"],
}
PART_NAMES = [name for names in PART_FAMILIES.values() for name in names]
PART_FAMILY = {name: family for family, names in PART_FAMILIES.items() for name in names}

PART_DICTIONARY = (
    "dictionary(ord, name, family) AS (VALUES "
    + ", ".join(f"({i}, '{n}', '{PART_FAMILY[n]}')" for i, n in enumerate(PART_NAMES))
    + ")"
)


def simplified_sql(column: str) -> str:
    cases = " ".join(f"WHEN contains({column}, '{n}') THEN '{n}'" for n in PART_NAMES)
    return f"CASE {cases} ELSE {column} END"


def any_name_sql(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in PART_NAMES) + ")"
