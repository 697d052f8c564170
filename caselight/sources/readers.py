"""Sources (S1-S13): tables with a declared schema, sheets as text, embeddings in three layouts, documents, folders."""

from __future__ import annotations

import io
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """The schema's columns in order, cast; absent ones are null, absent required ones are an error. Texts that can't be read as a type become null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    pick = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
    return df.select(*(pick(f).alias(f.name) for f in schema))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = (), fmt: str = "parquet") -> DataFrame:
    """A Parquet or CSV table, only the wanted columns that exist, the others null."""
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    return conform(raw, schema, required)


def read_sheets(spark: SparkSession, folder: str, sheets: list[str], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """CSV sheets as text, each row with its source row; a sheet that isn't there is an error. columns narrows a sheet."""
    out = {}
    for sheet in sheets:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{sheet}.csv")
        keep = [c for c in (columns or {}).get(sheet, df.columns) if c in df.columns]
        if repeated := {c for c in df.columns if df.columns.count(c) > 1}:
            raise ValueError(f"{sheet} has columns that repeat: {', '.join(sorted(repeated))}")
        out[sheet] = numbered(df).select(*(F.col(f"`{c}`") for c in keep), "source_row")
    return out


def numbered(df: DataFrame, first: int = 2) -> DataFrame:
    """The rows of files that are read whole, with source_row: their place from first on (2: below a header), files in the order of their paths.

    Each file's rows are counted; the counts, one a file, are with the driver.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low")).collect()
    start, starts = first, []
    for r in sorted(counts, key=lambda r: r["_file"]):
        starts.append((r["_file"], start - r["low"]))
        start += r["n"]
    shift = df.sparkSession.createDataFrame(starts, "_file string, _shift long")
    return rows.join(F.broadcast(shift), "_file").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_id") + F.col("_shift")).alias("source_row"))


def non_empty_rows(df: DataFrame, ignore: tuple[str, ...] = ("source_row",)) -> DataFrame:
    """Rows with at least one known cell."""
    return df.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in df.columns if c not in ignore)).isNotNull())


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """The columns with at least one known cell; one pass."""
    known = df.agg(*(F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if known[c]))


def union_projected(tables: list[DataFrame]) -> DataFrame:
    """Tables of one kind after another, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_mapping(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """An editable concept map: text columns, absent ones '', status in lower case."""
    names = ("source_table", "source_key", "target_code", "status", "use_value", "multiplier", "offset")
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    out = conform(df, T.StructType([T.StructField(n, T.StringType()) for n in names]), ("source_table", "source_key")).na.fill("")
    return out.withColumn("status", F.lower(F.trim("status")))


def embeddings(df: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """id, vector from an array column, a JSON text or columns vector_0000, vector_0001, ..."""
    if vector in df.columns:
        text = isinstance(df.schema[vector].dataType, T.StringType)
        return df.select(id_col, (F.from_json(vector, "array<float>") if text else F.col(vector).cast("array<float>")).alias(vector))
    wide = sorted((c for c in df.columns if re.fullmatch(rf"{re.escape(vector)}_\d+", c)), key=lambda c: int(c.rsplit("_", 1)[1]))
    if not wide:
        raise ValueError(f"no column of {vector}")
    return df.select(id_col, F.array(*(F.col(c).cast("float") for c in wide)).alias(vector))


def lookup(df: DataFrame, equals: dict[str, object], columns: list[str], limit: int) -> DataFrame:
    """The first rows with the given values; the filter and the columns reach the scan."""
    for c, v in equals.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.select(*columns).limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line; a line that isn't JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def selective(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in a table of keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def read_topk(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ranked lists from CSV; malformed rows are an error, or left out."""
    schema = "query_patient_id string, rank int, related_patient_id string, cosine_similarity double"
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').option("mode", "FAILFAST" if strict else "DROPMALFORMED").csv(path)
    return df.select(F.col("query_patient_id").alias("query_id"), "rank", F.col("related_patient_id").alias("candidate_id"), F.col("cosine_similarity").alias("score"))


def read_tree(spark: SparkSession, root: str, schema: T.StructType | str, levels: tuple[str, ...]) -> DataFrame:
    """JSON documents under nested folders, with the last folders' names as columns."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(root).withColumn("_path", F.col("_metadata.file_path"))
    parts = F.split("_path", "/")
    for i, name in enumerate(reversed(levels)):
        df = df.withColumn(name, F.get(parts, F.size(parts) - 2 - i))
    return df


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, size of the files below a folder with one of the suffixes, in the order of their paths; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    return df.where(F.lower("path").rlike("(?:" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$")).orderBy("path")


def discover_calls(spark: SparkSession, root: str, folder: str = "calls", without: tuple[str, ...] = ("attempts.json",), depth: int = 6, most: int = 5000) -> DataFrame:
    """path of JSON files that lie in folders of a name, at most depth folders below the root, the first most in order; the limits are the feature."""
    found = discover(spark, root, (".json",)).select("path")
    inside = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), F.lit(re.sub(r"^[a-z]+:/*|^/+|/+$", "", root) + "/"), F.lit(""))
    parts = F.split(inside, "/")
    kept = found.where((F.get(parts, F.size(parts) - 2) == folder) & (F.size(parts) - 1 <= depth) & ~F.element_at(parts, -1).isin(*without))
    return kept.orderBy("path").limit(most)


def read_arrays(spark: SparkSession, root: str, levels: tuple[str, ...] = ()) -> DataFrame:
    """path, shape, values of the NumPy files below a folder, with the last folders' names as columns; object arrays are an error."""

    @F.pandas_udf("struct<shape:array<int>,values:array<double>>")
    def load(content: pd.Series) -> pd.DataFrame:
        arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        return pd.DataFrame({"shape": [list(a.shape) for a in arrays], "values": [a.astype(float).ravel() for a in arrays]})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    parts = F.split("path", "/")
    named = [F.get(parts, F.size(parts) - 2 - i).alias(name) for i, name in enumerate(reversed(levels))]
    return df.select("path", *reversed(named), load("content").alias("a")).select("path", *levels, "a.shape", "a.values")
