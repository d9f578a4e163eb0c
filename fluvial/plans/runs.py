"""Queries on runs of several stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators.forecast import warning_level
from fluvial.plans.adapters import table
from fluvial.plans.registry import query
from fluvial.sources import audit
from fluvial.streaming.windows import shared_folder

_STAGES = """d AS (SELECT o_orderkey, o_custkey, round(o_totalprice / 10000, 4) AS depth FROM orders), p AS (SELECT o_custkey, max(depth) AS peak, count(*) AS n FROM d GROUP BY o_custkey),
w AS (SELECT o_custkey, CASE WHEN peak >= 50 THEN 'orange' WHEN peak >= 30 THEN 'yellow' WHEN peak >= 15 THEN 'blue' ELSE 'none' END AS level, peak FROM p WHERE n >= 2)"""


@query("audited_stages", f"""WITH {_STAGES} SELECT 'depth' AS stage, count(*) AS n, round(sum(depth), 2) AS total, 1 AS successes, 0 AS failures FROM d
UNION ALL SELECT 'peak', count(*), round(sum(peak), 2), 1, 1 FROM p UNION ALL SELECT 'warning', count(*), round(sum(peak), 2), 1, 0 FROM w""")
def audited_stages(spark, d):
    """A run over all orders that fails in its second stage, and is called again: each row of each stage once."""
    path, attempts = f"{shared_folder(spark)}/run", iter((RuntimeError("the machine is gone"),))

    def peak(rows):
        for e in attempts:
            raise e
        return rows.groupBy("o_custkey").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))

    stages = [
        ("depth", "o_orderkey long, o_custkey long, depth double", lambda o: o.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") / 10000, 4).alias("depth"))),
        ("peak", "o_custkey long, depth double, n long", peak),
        ("warning", "o_custkey long, depth double, level string", lambda p: p.where("n >= 2").select("o_custkey", "depth", warning_level(F.col("depth")).alias("level"))),
    ]
    try:
        audit.run_stages(spark, path, "r1", stages, table(spark, d, "orders"))
    except RuntimeError:
        audit.run_stages(spark, path, "r1", stages, table(spark, d, "orders"))
    rows = [audit.AuditTable(spark, f"{path}/stages/{n}", s).rows().groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("depth"), 2).alias("total")) for n, s, _ in stages]
    log = audit.AuditTable(spark, f"{path}/stage_runs", audit.STAGE_RUNS).rows()
    notes = log.groupBy("stage").agg(F.count_if(F.col("status") == "success").cast("int").alias("successes"), F.count_if(F.col("status") == "failed").cast("int").alias("failures"))
    return rows[0].union(rows[1]).union(rows[2]).join(notes, "stage")
