"""JSON lines, CSV and segmented tables. Paths may be on any file system Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizes import BROADCAST_ROWS, rows_within

SEGMENT = ("DrugFamily", "bert_compound_threshold")
# Rows of long text that are written by one task.
TEXT_ROWS_PER_FILE = 20_000

# The fields of a drug record and of the reviews within it, in file order.

RECORD_FIELDS = [
    "Condition", "Drug", "Indication", "Type", "Use", "HowtoUse", "Sides", "Precautions",
    "Interactions", "BrandName", "GenName", "AvoidUse", "Allergies", "DrugId", "NumReviews",
    "Effectiveness", "EaseofUse", "Satisfaction", "Reviews",
]
REVIEW_FIELDS = [
    "Id", "Condition", "IsPatient", "IsMale", "Age", "TimeUsingDrug", "DatePosted", "Comment",
    "Effectiveness", "EaseOfUse", "Satisfaction", "NumFoundHelpful", "NumVoted",
]

# End of the fixed values.

REVIEW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in REVIEW_FIELDS])
RECORD_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in RECORD_FIELDS[:-1]]
    + [T.StructField("Reviews", T.ArrayType(REVIEW_SCHEMA))]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows of long text. A table with fewer splits than the session has cores is spread
    over the cores first, since the work per row is large; a large table stays as it is."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV written by `write_csv`. Nested columns come back as JSON text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\\N")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])
    (
        flat.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", "\\N")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


# Possessive loops: no step per character, so strings may have any length.
_QUOTED = r"""('[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_MARK = "\x01"


def _replace_bare(text: Column, word: str, replacement: str) -> Column:
    """Replace a word outside quotes.

    Strings and bare words are matched together and followed by a mark; the marks behind a
    closing quote are taken away again, the others stand where a bare word was.
    """
    marked = F.regexp_replace(text, rf"(?s){_QUOTED}|\b{word}\b", f"$1{_MARK}")
    return F.regexp_replace(F.regexp_replace(marked, f"(['\"]){_MARK}", "$1"), _MARK, replacement)


def decode_records(text: Column | str, schema: str | T.DataType) -> Column:
    """Records written as JSON or as a Python literal with bare None, True and False."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*+)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        text = _replace_bare(text, python, json)
    return F.from_json(text, schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.select(*fields)


# --- segments -----------------------------------------------------------------------------


def write_segments(df: DataFrame, path: str, segment: Sequence[str] = SEGMENT, rows_per_file: int = 1_000_000) -> None:
    """One directory per segment, in files of about `rows_per_file` rows.

    The rows are dealt out by segment and, within a large one, over as many tasks as it has files:
    a small segment is one file, one with a third of all rows is written by many tasks. There are twice
    as many partitions as files, so that few files meet in one task.
    """
    counts = df.groupBy(*segment).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(s).alias(f"_{s}") for s in segment], F.ceil(F.col("_n") / rows_per_file).alias("_files"))
    few = rows_within(counts, BROADCAST_ROWS)
    side = counts if few is None else F.broadcast(df.sparkSession.createDataFrame(few, counts.schema))
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in segment])
    salted = df.join(side, same, "left").drop(*[f"_{s}" for s in segment])
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.col("_files"), F.lit(1))))
    partitions = [] if few is None else [max(2 * sum(r["_files"] for r in few), df.sparkSession.sparkContext.defaultParallelism)]
    dealt = salted.repartition(*partitions, *segment, "_salt").drop("_salt", "_files")
    writer = dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(*segment).parquet(path)


def read_segment(spark: SparkSession, path: str, schema: T.StructType | None = None, **segment: str) -> DataFrame:
    """Rows of one segment; the other directories are not read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    for column, value in segment.items():
        df = df.where(F.col(column) == value)
    return df


def segment_manifest(df: DataFrame, segment: Sequence[str] = SEGMENT, root: str = "segments") -> DataFrame:
    """`(segment columns…, name, path, rows)`, one row per segment present."""
    counts = df.dropna("any", subset=list(segment)).groupBy(*segment).agg(F.count(F.lit(1)).alias("rows"))
    name = F.concat_ws("_", *segment)
    return counts.withColumn("name", name).withColumn("path", F.concat_ws("/", F.lit(root), name))


# --- models -------------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
