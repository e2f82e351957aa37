"""File sources and sinks: delimited loads, task documents, spaces, feature and metric tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.features import DOCUMENT_SCHEMA


def _ddl(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def read_delimited(spark: SparkSession, path: str, schema, encoding: str = "UTF-8", empty_is_null: bool = False) -> DataFrame:
    """Pipe-delimited rows with a trailing delimiter; fixed-width text loses its padding."""
    fields = _ddl(schema).fields
    # read as nullable and with the empty last column, then drop it
    wide = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("_end", T.StringType(), True)])
    reader = spark.read.schema(wide).option("sep", "|").option("encoding", encoding).option("mode", "FAILFAST")
    df = reader.option("nullValue", "").csv(path) if empty_is_null else reader.option("emptyValue", "").csv(path)
    cols = [F.rtrim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in fields]
    return df.select(*cols)


def load_suite(spark: SparkSession, folder: str, schemas: dict, suffix: str, encoding: str = "UTF-8", empty_is_null: bool = False) -> dict[str, DataFrame]:
    """All tables of a suite whose file exists; a missing file is left out."""
    jvm = spark._jvm
    out = {}
    for name, schema in schemas.items():
        path = os.path.join(folder, f"{name}.{suffix}")
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            out[name] = read_delimited(spark, path, schema, encoding, empty_is_null)
    return out


def declare(spark: SparkSession, paths: dict[str, str], database: str) -> list[str]:
    """Parquet files as tables of a catalogue database, with statistics of all their columns for the cost-based optimizer."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for name, path in paths.items():
        table = f"`{database}`.`{name}`"
        spark.sql(f"CREATE TABLE {table} USING parquet OPTIONS (path '{path}')")
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
        names.append(table)
    return names


def forget(spark: SparkSession, tables: list[str]) -> None:
    """Take declared tables and their databases out of the catalogue; their files stay."""
    for database in {t.split(".")[0] for t in tables}:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def statistics(spark: SparkSession, tables: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name, rows, nulls, distinct, low, high) of integer columns, as the catalogue holds them."""
    out = []
    for table in tables:
        name = table.split(".")[1].strip("`")
        held = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        rows = int(held["Statistics"].split(",")[-1].split()[0])
        for column in columns[name]:
            info = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {table} `{column}`").collect()}
            out.append((name, column, rows, *[int(info[k]) for k in ("num_nulls", "distinct_count", "min", "max")]))
    return spark.createDataFrame(out, "table_name string, column_name string, rows long, nulls long, distinct long, low long, high long")


def _documents(spark: SparkSession, folders: tuple[str, ...]) -> DataFrame:
    """Every document under the folders once, with its path; what is no document has its text in ``_rejected``."""
    reader = spark.read.schema(f"{DOCUMENT_SCHEMA}, _rejected string").option("recursiveFileLookup", "true").option("pathGlobFilter", "task_*.json")
    reader = reader.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected")
    raw = reader.json(sorted({os.path.realpath(f) if "://" not in f else f for f in folders})).withColumn("path", F.col("_metadata.file_path"))
    return raw.dropDuplicates(["path"])


def read_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """Task documents under the folders: running tasks dropped, a path once. Unreadable files are in :func:`rejected_documents`."""
    return _documents(spark, folders).where("_rejected is null and (status is null or status <> 'running')").drop("path", "_rejected")


def rejected_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, task_id, text) of the files that hold no whole task document; the task_id as far as it could be read."""
    return _documents(spark, folders).where("_rejected is not null").select("path", "task_id", F.col("_rejected").alias("text"))


def read_space(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter spaces ``stage*/tier.json`` in normal form; ``_meta`` entries dropped."""
    entry = "struct<type: string, choices: struct<mode: string, values: string>>"
    text = spark.read.text(f"{folder.rstrip('/')}/stage*/*.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    params = text.select(
        F.regexp_extract("path", r"stage(\d+)/[^/]+\.json$", 1).cast("int").alias("stage"),
        F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("tier"),
        F.explode(F.from_json("value", f"map<string, {entry}>")).alias("param", "spec"),
    ).where("param <> '_meta'")
    values = F.col("spec.choices.values")
    ranged = F.from_json(values, "min double, max double")
    listed = F.from_json(values, "array<string>")
    is_range = F.col("spec.choices.mode") == "range"
    base = params.select("stage", "tier", "param", F.col("spec.type").alias("type"), F.col("spec.choices.mode").alias("mode"),
                         F.when(is_range, ranged).alias("r"), F.when(~is_range, listed).alias("l"))
    return base.select("stage", "tier", "param", "type", "mode", "r.min", "r.max", F.posexplode_outer("l").alias("idx", "choice"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate configurations from one JSON array, numbered in file order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("candidate_idx", "config"))


def project_json(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Fields of a JSON text column by path."""
    return df.select("*", *[F.get_json_object(column, p).alias(n) for n, p in paths.items()])


def write_features(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Feature table, one folder per tier; CSV for exchange."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.partitionBy("tier").parquet(path)


def read_features(spark: SparkSession, path: str, schema=None, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").csv(path) if form == "csv" else reader.parquet(path)


def append_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Put a run's metric rows into a growing table keyed by run; a repeated run replaces its own rows only."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
