"""Sinks: audit tables, JSON lines, CSV with lists, reports and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators.stats import latest

RUN_SCHEMA = "run_id string, recorded_at timestamp, status string, metrics map<string,double>, note string"
STAGE_SCHEMA = "run_id string, stage string, started timestamp, ended timestamp, status string, return_code int, output_tail string"
ARTIFACT_SCHEMA = "run_id string, artifact_type string, path string, present boolean, note string"


def append(df: DataFrame, path: str, schema: str | None = None) -> None:
    """Append rows to a Parquet table, cast to its schema; columns that the schema lacks are refused."""
    if schema:
        typed = df.sparkSession.createDataFrame([], schema)
        extra = set(df.columns) - set(typed.columns)
        if extra:
            raise ValueError(f"columns not in the table: {sorted(extra)}")
        df = typed.unionByName(df, allowMissingColumns=True).select(*(F.col(n).cast(t) for n, t in typed.dtypes))
    df.write.mode("append").parquet(path)


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of each run, from a table to which each change of state was appended."""
    return latest(spark.read.option("mergeSchema", True).parquet(path), ["run_id"], ["recorded_at", "status"])


def guarded_append(df: DataFrame, path: str, keys: Sequence[str], rules: dict[str, Column]) -> None:
    """Append rows that all obey the rules and whose keys are new, in the table and among themselves; else nothing is written."""
    spark = df.sparkSession
    broken = df.select(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items())).first() if rules else {}
    bad = [n for n in rules if broken[n]]
    if bad:
        raise ValueError(f"rows break {bad}")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("keys repeat")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and not df.join(spark.read.parquet(path), list(keys), "left_semi").isEmpty():
        raise ValueError("keys are there already")
    df.write.mode("append").parquet(path)


def keyed_read(spark: SparkSession, path: str, key: str, value, order: Sequence[str]) -> DataFrame:
    """Rows of one key in order; an unknown key is an error."""
    rows = spark.read.parquet(path).where(F.col(key) == value)
    if rows.isEmpty():
        raise KeyError(value)
    return rows.orderBy(*order)


def without_nan(df: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold become null."""
    return df.withColumns({n: F.when(~F.isnan(n) & (F.abs(F.col(n)) != float("inf")), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    without_nan(df).write.mode(mode).json(path)


def list_text(df: DataFrame, separator: str = "|") -> DataFrame:
    """Array columns joined to text, for CSV."""
    return df.withColumns({n: F.concat_ws(separator, n) for n, t in df.dtypes if t.startswith("array<")})


def write_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    list_text(df, separator).write.mode("overwrite").option("header", True).csv(path)


def audit_line(rows: DataFrame, keys: Sequence[str], horizon: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """One JSON text a key with the value at each horizon as a field of its own; a missing one is null there."""
    wide = rows.groupBy(*keys).agg(*(F.max(F.when(F.col(horizon) == h, F.col(value))).alias(f"forecast_{h}min") for h in horizons))
    return wide.select(*keys, F.to_json(F.struct(*keys, *(f"forecast_{h}min" for h in horizons)), {"ignoreNullFields": "false"}).alias("line"))


def report(one: DataFrame, title: str, lines: Sequence[tuple[str, str]]) -> DataFrame:
    """Markdown text of a one-row table: a line for each (label, column); missing values read N/A."""
    parts = [F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for label, c in lines]
    return one.select(F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *parts).alias("markdown"))


def model_row(spark: SparkSession, model: dict, version: str) -> DataFrame:
    """A logistic model as one row; load_model reads it back."""
    return spark.createDataFrame([(version, model["features"], model["weights"], float(model["bias"]), model["mean"], model["std"])], "version string, features array<string>, weights array<double>, bias double, mean array<double>, std array<double>")


def load_model(spark: SparkSession, path: str, version: str) -> dict:
    rows = spark.read.parquet(path).where(F.col("version") == version).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(version)
    return rows[0].asDict()
