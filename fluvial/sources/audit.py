"""Audit tables that can be written again: a batch is committed once, by one rename, and readers see committed batches alone.

A table is a folder of `run_id=../stage=../batch=..` folders of Parquet files. A writer puts its rows under
`_staging`, which readers skip, and renames that folder to its place; the file system refuses a second rename to
one place. So a writer that was killed leaves nothing to see, and one that comes again for a batch finds it there.
"""

from __future__ import annotations

import errno
import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "run_id string, stage string, batch long"
STAGE_RUNS = "started timestamp, ended timestamp, status string, rows long, reason string"


class AuditTable:
    """schema: DDL of the rows, without the key columns run_id, stage and batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema)
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _place(self, run_id: str, stage: str, batch: int) -> str:
        """Spark reads escaped names back as they were."""
        return f"{self.path}/run_id={quote(run_id, safe='')}/stage={quote(stage, safe='')}/batch={int(batch)}"

    def _files(self, path: str):
        where = self._hadoop.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, run_id: str, stage: str, batch: int = 0) -> bool:
        where, files = self._files(self._place(run_id, stage, batch))
        return files.exists(where)

    def commit(self, rows: DataFrame, run_id: str, stage: str, batch: int = 0, rules: dict[str, Column] | None = None, keys: Sequence[str] = ()) -> bool:
        """Write rows as a batch; False, and nothing is seen of these, where the batch is there already.

        rules must hold for all rows and keys must not repeat among them, else ValueError, before anything is
        written. Columns beyond the schema are an error, missing ones are null.
        """
        if self.has(run_id, stage, batch):
            return False
        extra = {*rows.columns} - {*self.schema.names}
        if extra:
            raise ValueError(f"columns not in the table: {sorted(extra)}")
        broken = rows.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items())).first() if rules else {}
        if bad := [n for n in rules or {} if broken[n]]:
            raise ValueError(f"rows break {bad}")
        if keys and not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{[*keys]} repeat")
        typed = rows.select(*((F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema))
        staged = f"{self.path}/_staging/{uuid.uuid4()}"
        typed.write.parquet(staged)
        return self._rename(staged, self._place(run_id, stage, batch))

    def _rename(self, staged: str, place: str) -> bool:
        (source, files), (target, _) = self._files(staged), self._files(place)
        files.mkdirs(target.getParent())
        if files.getUri().getScheme() == "file":
            # Hadoop copies into a folder that is there; the system's own rename refuses one that holds files
            try:
                os.rename(source.toUri().getPath(), target.toUri().getPath())
            except OSError as e:
                if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                    raise
                files.delete(source, True)
                return False
            return True
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # an existing place is an error
        try:
            self._hadoop.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, never)
        except Py4JJavaError as e:
            if not files.exists(target):
                raise
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            files.delete(source, True)
            return False
        return True

    def rows(self) -> DataFrame:
        """Committed rows with run_id, stage and batch; an empty table before the first commit."""
        key = T.StructType.fromDDL(KEY)
        whole = T.StructType([*self.schema, *key])
        where, files = self._files(self.path)
        if not files.exists(where) or not any(s.getPath().getName().startswith("run_id=") for s in files.listStatus(where)):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def sink(self, run_id: str, stage: str, **checks) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a batch that is given again after a failure is committed once."""

        def write(rows: DataFrame, batch: int) -> None:
            self.commit(rows, run_id, stage, batch, **checks)

        return write

    def sweep(self) -> None:
        """Delete what writers that ended without a commit left; no writer may be at work."""
        where, files = self._files(f"{self.path}/_staging")
        files.delete(where, True)


def run_stages(spark: SparkSession, path: str, run_id: str, stages: Sequence[tuple[str, str, Callable[[DataFrame], DataFrame]]], first: DataFrame) -> DataFrame:
    """Run (name, schema, function) stages one after another, each on what the one before committed; gives the last one's rows.

    A run that was killed is called again with the same run_id: stages that committed are read, not run, so
    every row of every stage is there once. A stage that raises is noted as failed, with its reason, and the
    error goes on; called again the run continues from it. stage_runs has one success a stage (batch 0) and
    one row for each failure (1, 2, ...).
    """
    log, rows = AuditTable(spark, f"{path}/stage_runs", STAGE_RUNS), first
    now = lambda: spark.sql("SELECT current_timestamp() AS t").first()["t"]
    noted = lambda began, status, n, why, batch, name: log.commit(spark.createDataFrame([(began, now(), status, n, why)], STAGE_RUNS), run_id, name, batch)
    for name, schema, stage in stages:
        out, began = AuditTable(spark, f"{path}/stages/{name}", schema), now()
        try:
            out.commit(stage(rows), run_id, name) if not out.has(run_id, name) else None
        except Exception as e:
            failures = log.rows().where((F.col("run_id") == run_id) & (F.col("stage") == name) & (F.col("batch") > 0)).count()
            noted(began, "failed", None, str(e)[:1000], failures + 1, name)
            raise
        rows = out.rows().where((F.col("run_id") == run_id) & (F.col("stage") == name)).drop("run_id", "stage", "batch")
        if not log.has(run_id, name):
            noted(began, "success", rows.count(), None, 0, name)
    return rows


def run_status(spark: SparkSession, path: str, stages: Sequence[str]) -> DataFrame:
    """One row a run: success when all stages are, failed when the last note of an unfinished stage is a failure, else running."""
    log = AuditTable(spark, f"{path}/stage_runs", STAGE_RUNS).rows()
    good = (F.col("status") == "success") & F.col("stage").isin(*stages)
    per = log.groupBy("run_id", "stage").agg(F.max(good).alias("_ok"), F.count_if(F.col("status") == "failed").alias("_failures"))
    done, open_failures = F.count_if("_ok"), F.count_if(~F.col("_ok") & (F.col("_failures") > 0))
    status = F.when(done == len(stages), "success").when(open_failures > 0, "failed").otherwise("running")
    return per.groupBy("run_id").agg(status.alias("status"), done.alias("stages_done"), F.sum("_failures").alias("failures"))
