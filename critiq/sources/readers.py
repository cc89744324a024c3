"""Readers for CSV, JSON, parquet, JDBC and MongoDB, and the dispatcher.

Every reader returns a DataFrame aligned to the standard review schema.
Credentials always come from the caller; nothing is defaulted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from critiq.functions.num import with_scalars
from critiq.operators.common import hash_cuts, hash_key
from critiq.sources.schema import align_columns

JSON_WRAPPERS = ("reviews", "data")   # fixed values: keys tried, in order


def from_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multiline: bool = True, align: bool = True, null_value: str | None = None) -> DataFrame:
    """Header CSV, UTF-8 with or without BOM, quoted fields with line breaks.
    Empty fields read as null (as a pandas reader does) unless ``null_value``
    names an explicit null marker, in which case "" stays an empty string.

    Line breaks in quoted fields belong to the text, so a file is read by one
    task; ``multiline=False``, for files known to have none, lets large files
    split over tasks.
    """
    r = (spark.read.option("header", True).option("multiLine", multiline)
         .option("escape", '"').option("encoding", "UTF-8"))
    if null_value is not None:
        r = r.option("nullValue", null_value).option("emptyValue", "")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
    df = r.csv(path)
    # a UTF-8 BOM may survive on the first header name
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return align_columns(df) if align else df


def from_csv_lenient(spark: SparkSession, path: str, required=("text", "stars_y"),
                     schema: T.StructType | None = None, null_value: str | None = None,
                     multiline: bool = True) -> DataFrame:
    """Skip malformed lines and rows missing a required field (``multiline``
    as in ``from_csv``)."""
    r = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    r = r.option("mode", "DROPMALFORMED")
    if null_value is not None:
        r = r.option("nullValue", null_value).option("emptyValue", "")
    df = (r.schema(schema) if schema is not None else r).csv(path)
    return df.dropna(subset=[c for c in required if c in df.columns])


def _flatten(df: DataFrame) -> DataFrame:
    """Nested structs -> dotted column names (as a JSON normaliser does)."""
    cols, stack = [], [((), df.schema)]
    while stack:
        prefix, st = stack.pop()
        for f in st.fields:
            path = prefix + (f.name,)
            if isinstance(f.dataType, T.StructType):
                stack.append((path, f.dataType))
            else:
                cols.append(path)
    cols.sort()
    return df.select(*[F.col("`" + "`.`".join(p) + "`").alias(".".join(p)) for p in cols])


def from_json(spark: SparkSession, path: str, lines: bool | None = None,
              align: bool = True) -> DataFrame:
    """A top-level list, an object wrapping ``reviews`` or ``data``, a single
    object, or JSON Lines (``lines=True``; the splittable form for scale)."""
    if lines:
        df = spark.read.json(path)
    else:
        df = spark.read.option("multiLine", True).json(path)
        for key in JSON_WRAPPERS:
            if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) \
                    and isinstance(df.schema[key].dataType.elementType, T.StructType):
                df = df.select(F.inline(key))
                break
    df = _flatten(df)
    return align_columns(df) if align else df


def from_parquet(spark: SparkSession, path: str, align: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return align_columns(df) if align else df


def from_jdbc(spark: SparkSession, url: str, user: str | None = None, password: str | None = None,
              query: str | None = None, table: str | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None,
              driver: str | None = None, align: bool = True) -> DataFrame:
    """Read through JDBC.  With a numeric ``partition_column`` and bounds,
    Spark issues ``num_partitions`` range queries in parallel."""
    r = spark.read.format("jdbc").option("url", url)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if driver:
        r = r.option("driver", driver)
    if partition_column:
        if table is None:
            raise ValueError("partitioned JDBC reads need `table` (a table or a sub-query alias)")
        r = (r.option("dbtable", table).option("partitionColumn", partition_column)
              .option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", num_partitions or 8))
    elif query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    df = r.load()
    return align_columns(df) if align else df


def from_mongodb(spark: SparkSession, uri: str, database: str, collection: str,
                 pipeline: str | None = None, align: bool = True) -> DataFrame:
    """Needs the MongoDB Spark connector on the classpath (not bundled)."""
    r = (spark.read.format("mongodb").option("connection.uri", uri)
         .option("database", database).option("collection", collection))
    if pipeline:
        r = r.option("aggregation.pipeline", pipeline)
    df = r.load()
    if "_id" in df.columns:
        df = df.drop("_id")
    return align_columns(df) if align else df


def load(spark: SparkSession, source: str, **kwargs) -> DataFrame:
    """Dispatch by suffix (.csv, .json, .jsonl, .parquet) or by name
    (``jdbc``/``mysql``, ``mongodb``)."""
    s = source.lower().rstrip("/")
    if s.endswith(".csv"):
        return from_csv(spark, source, **kwargs)
    if s.endswith(".jsonl"):
        return from_json(spark, source, lines=True, **kwargs)
    if s.endswith(".json"):
        return from_json(spark, source, **kwargs)
    if s.endswith(".parquet"):
        return from_parquet(spark, source, **kwargs)
    if s in ("jdbc", "mysql"):
        return from_jdbc(spark, **kwargs)
    if s == "mongodb":
        return from_mongodb(spark, **kwargs)
    raise ValueError(f"unknown source: {source}")


def hash_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """A reproducible sample of ``n`` rows from the whole table: the rows
    with the smallest md5 of their id.  The n-th smallest is found from
    counts (``hash_cuts``), and the sample is a filter: no sort, and no task
    holds the sample, whatever ``n``.  Rows that share an id stay together, so
    a repeated id at the border may add its other rows."""
    if n < 1:
        return df.limit(0)
    cuts = hash_cuts(df, id_col, [F.lit(n)])
    return with_scalars(df, cuts).where(hash_key(id_col) <= F.col("cuts")[0]).select(*df.columns)


def fraction_sample(df: DataFrame, fraction: float, id_col: str) -> DataFrame:
    """Approximate-size sample by hash threshold (partitioning-independent)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return df.where(h < F.lit(int(fraction * 0xFFFFFFFF)))
