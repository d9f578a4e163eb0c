"""Queries whose groups grow with the table: selection, retrieval and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import joins, quantiles
from fluvial.plans.adapters import WIDE_RASTER, table, wide_raster
from fluvial.plans.registry import query, r4
from fluvial.sources.checkpoints import cut

#: Values of one group that a task may hold in these queries: a tenth of lineitem's groups at the smallest scale.
HELD = 256


@query("selected_quantiles", "SELECT l_returnflag AS part, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def selected_quantiles(spark, d):
    found = quantiles.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, HELD)
    return found.select(F.col("l_returnflag").alias("part"), "n", r4("p10"), r4("p50"), r4("p95"))


@query("pooled_median_deviation", "WITH m AS (SELECT median(value) AS m FROM events) SELECT count(*) AS n, round(max(m), 4) AS median, round(median(abs(value - m)), 4) AS mad FROM events, m")
def pooled_median_deviation(spark, d):
    found = quantiles.median_deviation(table(spark, d, "events"), [], "value", HELD)
    return found.select("n", r4("median"), r4("mad"))


@query("far_distances", f"""WITH {WIDE_RASTER}, a AS (SELECT ix, iy FROM wide WHERE ix < 8), b AS (SELECT ix, iy FROM wide WHERE ix >= 90 AND z < 30000)
SELECT a.ix, a.iy, round(sqrt(min(power(a.ix - b.ix, 2) + power(a.iy - b.iy, 2))), 6) AS distance FROM a, b GROUP BY a.ix, a.iy""")
def far_distances(spark, d):
    cells = cut(wide_raster(spark, d))
    found = joins.nearest_distance(cells.where("ix < 8"), cells.where("ix >= 90 AND z < 30000"))
    return found.select("ix", "iy", F.round("distance", 6).alias("distance"))
