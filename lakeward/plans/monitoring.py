"""Queries over drift, evaluation, splits, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import gram, phrases, temperature
from lakeward.operators import monitoring as M
from lakeward.operators import splitting as P
from lakeward.operators import statistics as S
from lakeward.operators import texts as X
from lakeward.operators import vectors as V
from lakeward.operators import wide
from lakeward.operators.ranks import nearest_rank, quantile, running
from lakeward.operators.tables import written
from lakeward.registry import query, table

_EV = "e AS (SELECT event_type, user_id, event_id, value, day(ts) <= 10 AS base, (day(ts) - 1) // 3 AS period, ts FROM events)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", "user_id", "event_id", "value", "ts", (F.day("ts") <= 10).alias("base"), F.floor((F.day("ts") - 1) / 3).alias("period"))


_KS = f"""
WITH {_EV}, c AS (SELECT event_type, value, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM e GROUP BY 1, 2),
g AS (SELECT event_type, b, n, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY event_type), w AS (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT event_type, sum(b)::BIGINT AS n_base, sum(n)::BIGINT AS n_now, max(gap) AS ks FROM g GROUP BY 1),
q AS (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM e WHERE base GROUP BY 1),
h AS (SELECT e.event_type, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM e JOIN q USING (event_type) GROUP BY ALL),
s AS (SELECT event_type, b / sum(b) OVER (PARTITION BY event_type) + 1e-6 AS o, n / sum(n) OVER (PARTITION BY event_type) + 1e-6 AS c FROM h), psi AS (SELECT event_type, sum((c - o) * ln(c / o)) AS psi FROM s GROUP BY 1)
"""


@query(_KS + "SELECT event_type, n_base, n_now, round(ks, 9) AS ks FROM k")
def w06_ks(spark: SparkSession, sf: str) -> DataFrame:
    return S.ecdf_distance(events(spark, sf), ["event_type"], "value", "base").withColumn("ks", F.round("ks", 9))


@query(_KS + "SELECT event_type, round(psi, 6) AS psi FROM psi")
def d01_psi(spark: SparkSession, sf: str) -> DataFrame:
    return S.population_stability(events(spark, sf), ["event_type"], "value", "base").withColumn("psi", F.round("psi", 6))


@query(_KS + """, p AS (SELECT event_type, n_base, n_now, ks, psi, ks * sqrt(n_base::DOUBLE * n_now / (n_base + n_now)) AS x FROM k JOIN psi USING (event_type)),
r AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * x * x))))) END AS p FROM p)
SELECT event_type, round(p, 6)::DOUBLE AS p, n_now >= 100 AND p < 0.01 AND psi >= 0.2 AS alert, n_now >= 100 AND NOT (n_now >= 100 AND p < 0.01 AND psi >= 0.2) AND psi >= 0.1 AS warning FROM r""")
def d02_drift(spark: SparkSession, sf: str) -> DataFrame:
    """KS and PSI by segment with alert and warning (D02, D03, A.16)."""
    return S.drift(events(spark, sf), ["event_type"], "value", "base").select("event_type", F.round("p", 6).alias("p"), "alert", "warning")


@query("""
WITH RECURSIVE e AS (SELECT event_type, user_id % 10 AS part, value, day(ts) <= 10 AS base FROM events), c AS (SELECT event_type, part, value, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM e GROUP BY ALL),
g AS (SELECT *, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY event_type, part), w AS (PARTITION BY event_type, part ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT event_type, part, sum(b)::BIGINT AS n, sum(n)::BIGINT AS m, max(gap) AS ks FROM g GROUP BY 1, 2), h AS (SELECT *, round(ks * n * m)::BIGINT AS h FROM k WHERE n > 0 AND m > 0),
r AS (SELECT event_type, part, n, m, h, 0::BIGINT AS i, list_transform(range(m + 1), lambda j: CASE WHEN j * n < h THEN 1.0::DOUBLE ELSE 0 END) AS u FROM h
  UNION ALL SELECT event_type, part, n, m, h, i + 1, list_transform(range(m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < h THEN (i + 1)::DOUBLE / (i + 1 + m) * list_sum(list_transform(range(j + 1), lambda x: CASE WHEN abs((i + 1) * m - x * n) < h THEN u[x + 1] ELSE 0 END)) ELSE 0 END) FROM r WHERE i < n)
SELECT event_type, part, n AS n_base, m AS n_now, round(h.ks, 9) AS ks, round(1 - u[m + 1], 9) AS p FROM r JOIN h USING (event_type, part, n, m) WHERE i = n
""")
def d02_exact(spark: SparkSession, sf: str) -> DataFrame:
    """KS of small segments with its exact p-value."""
    rows = events(spark, sf).withColumn("part", F.col("user_id") % 10)
    found = S.ecdf_distance(rows, ["event_type", "part"], "value", "base").where("n_base > 0 and n_now > 0")
    return S.ks_probability(found, "ks", "n_base", "n_now").withColumns({"ks": F.round("ks", 9), "p": F.round("p", 9)})


@query()
def d04_embedding_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Drift of five leading components fitted on the baseline, Bonferroni."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 2 == 0).alias("base"))
    directions, _ = V.components(rows.where("base"), "embedding", 5)
    flat = rows.select("base", F.posexplode(V.projected(F.col("embedding"), directions)).alias("component", "x"))
    return S.drift(flat, ["component"], "x", "base", alert_p=0.01 / 5)


_MIX = f"""
WITH {_EV}, l AS (SELECT DISTINCT user_id % 7 AS c FROM e), now AS (SELECT event_type, user_id % 7 AS c, count(*) AS o FROM e WHERE NOT base GROUP BY ALL), b AS (SELECT user_id % 7 AS c, count(*) AS b FROM e WHERE base AND user_id % 7 <> 6 GROUP BY 1),
x AS (SELECT t.event_type, l.c, coalesce(o, 0) AS o, coalesce(b, 0) AS b FROM (SELECT DISTINCT event_type FROM now) t CROSS JOIN l LEFT JOIN now ON now.event_type = t.event_type AND now.c = l.c LEFT JOIN b ON b.c = l.c)
SELECT event_type, round(sum(abs(o / n_o - b / n_b)) / 2, 9) AS tvd, bool_or(b = 0 AND o > 0) AS unseen FROM (SELECT *, sum(o) OVER w AS n_o, sum(b) OVER w AS n_b FROM x WINDOW w AS (PARTITION BY event_type)) GROUP BY 1
"""


@query()
def d04_wide_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Drift of the leading components of wide vectors, words counted in 1,024 places by
    their hash, between halves of the documents (D04)."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("words")
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 2 == 0).alias("base"), words)
    counted = HashingTF(inputCol="words", outputCol="held", numFeatures=1024).transform(docs)
    vectors = written(counted.select("base", F.transform(vector_to_array("held"), F.sqrt).alias("v")))  # read in every pass
    directions, _, _ = wide.components(vectors.where("base"), "v", 5)
    flat = wide.projected(vectors, "v", directions, "z", keep=False).select("base", F.posexplode("z").alias("component", "x"))
    return S.drift(flat, ["component"], "x", "base", alert_p=0.01 / 5)


@query(_MIX)
def d05_class_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("guess", F.col("user_id") % 7).where("not base or guess <> 6")
    return M.class_mix(rows, ["event_type"], "guess", "base").select("event_type", F.round("tvd", 9).alias("tvd"), "unseen")


@query(f"""
WITH {_EV}, now AS (SELECT * FROM e WHERE NOT base AND period >= 4), z AS (SELECT DISTINCT period FROM now),
bth AS (SELECT period, value, user_id % 5 AS g, false AS b FROM now UNION ALL SELECT z.period, value, user_id % 5, true FROM z, e WHERE base),
cell AS (SELECT period, g, count(*) FILTER (NOT b) AS o, count(*) FILTER (b) AS a FROM bth GROUP BY 1, 2), sums AS (SELECT *, sum(o) OVER w AS n_o, sum(a) OVER w AS n_a FROM cell WINDOW w AS (PARTITION BY period)),
mix AS (SELECT period, max(n_o) AS n, sum(abs(o / n_o - a / n_a)) / 2 AS tvd, bool_or(a = 0 AND o > 0) AS unseen, sum((o - a * n_o / n_a) * (o - a * n_o / n_a) / (a * n_o / n_a)) AS x FROM sums GROUP BY 1),
med AS (SELECT period, quantile_cont(value, 0.5) FILTER (NOT b) - quantile_cont(value, 0.5) FILTER (b) AS m FROM bth GROUP BY 1),
c AS (SELECT period, value, count(*) FILTER (b) AS b, count(*) FILTER (NOT b) AS n FROM bth GROUP BY 1, 2),
g AS (SELECT period, b, n, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY period), w AS (PARTITION BY period ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT period, max(gap) AS ks, max(gap) * sqrt(sum(b)::DOUBLE * sum(n) / (sum(b) + sum(n))) AS x FROM g GROUP BY 1),
q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM e WHERE base), h AS (SELECT period, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) FILTER (b) AS b, count(*) FILTER (NOT b) AS n FROM bth, q GROUP BY ALL),
s AS (SELECT period, b / sum(b) OVER w + 1e-6 AS o, n / sum(n) OVER w + 1e-6 AS c FROM h WINDOW w AS (PARTITION BY period)), psi AS (SELECT period, sum((c - o) * ln(c / o)) AS psi FROM s GROUP BY 1),
r AS (SELECT *, CASE WHEN k.x < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * k.x * k.x))) END AS p, exp(-mix.x / 2) * (1 + mix.x / 2) AS p_mix FROM mix JOIN med USING (period) JOIN k USING (period) JOIN psi USING (period))
SELECT period, round(tvd, 9) AS tvd, n >= 100 AND tvd >= 0.1 AND (unseen OR p_mix < 0.01) AS mix_alert, round(m, 6) AS median_change, n >= 100 AND p < 0.01 AND abs(m) >= 0.05 AS confidence_alert, round(ks, 9) AS ks, round(psi, 6) AS psi, n >= 100 AND p < 0.01 AND psi >= 0.2 AS score_alert FROM r
""")
def d07_month_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Class mix, confidence and score drift of each period side by side."""
    rows = events(spark, sf).where("base or period >= 4").withColumn("guess", F.col("user_id") % 5)
    periods = rows.where("not base").select("period").distinct()
    base = rows.where("base").drop("period").join(periods, F.lit(True))
    both = rows.where("not base").unionByName(base)
    mix = M.mix_alert(M.class_mix(both, ["period"], "guess", "base").join(both.where("not base").groupBy("period").agg(F.count("*").alias("n")), "period"), "n")
    shift = M.confidence_shift(both, ["period"], "value", "base")
    drift = S.drift(both, ["period"], "value", "base")
    return mix.select("period", F.round("tvd", 9).alias("tvd"), F.col("alert").alias("mix_alert")).join(shift.select("period", F.round("median_change", 6).alias("median_change"), F.col("alert").alias("confidence_alert")), "period").join(drift.select("period", F.round("ks", 9).alias("ks"), F.round("psi", 6).alias("psi"), F.col("alert").alias("score_alert")), "period")


@query(f"""
WITH {_EV}, c AS (SELECT quantile_cont(value, 0.95) AS cut FROM e WHERE base) SELECT event_type, count(*) AS n, round(avg((value > cut)::INT), 9) AS alert_rate FROM e, c WHERE NOT base GROUP BY 1
""")
def d09_alert_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each group above the baseline's 95th percentile."""
    rows = events(spark, sf)
    cut = quantile(rows.where("base"), [], "value", 0.95, "cut")
    return rows.where("not base").join(cut, F.lit(True)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > F.col("cut")).cast("int")), 9).alias("alert_rate"))


@query(f"""
WITH {_EV}, q AS (SELECT event_type, quantile_cont(value, 0.95) AS cut FROM e WHERE base GROUP BY 1) SELECT event_type, round(avg((value <= cut)::INT), 9) AS fpr FROM e JOIN q USING (event_type) WHERE NOT base GROUP BY 1
""")
def d10_fpr95(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("shifted", ~F.col("base"))
    return S.false_positive_rate(rows, ["event_type"], "value", "shifted").withColumn("fpr", F.round("fpr", 9))


@query("""
WITH g AS (SELECT s_nationkey AS grp, l_linestatus AS truth, CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'O' ELSE 'F' END AS guess FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT grp, truth, count(*) AS support, avg((truth = guess)::INT) AS recall FROM g GROUP BY ALL)
SELECT grp, sum(support)::BIGINT AS n, count(*) AS classes, round(sum(recall * support) / sum(support), 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy FROM c GROUP BY 1 HAVING sum(support) >= 100
""")
def d11_subgroups(spark: SparkSession, sf: str) -> DataFrame:
    """Recall, accuracy and balanced accuracy of groups of at least 100."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    guess = F.when(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), "O").otherwise("F")
    rows = lines.select(F.col("s_nationkey").alias("grp"), F.col("l_linestatus").alias("truth"), guess.alias("guess"))
    out = S.classification(rows, ["grp"], "truth", "guess").where("n >= 100")
    return out.withColumns({"accuracy": F.round("accuracy", 9), "balanced_accuracy": F.round("balanced_accuracy", 9)})


@query("""
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_linestatus = 'X') AS "X" FROM lineitem GROUP BY 1
""")
def a14_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O", "X"])


@query(f"""
WITH {_EV}, m AS (SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS positives, CASE WHEN day(ts::DATE) = 8 THEN NULL ELSE count(*) FILTER (value > 40) END AS hits FROM e GROUP BY event_type, ts::DATE),
w AS (SELECT *, coalesce(sum(positives) OVER (PARTITION BY event_type ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum((hits IS NULL)::INT) OVER (PARTITION BY event_type ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS gaps FROM m),
s AS (SELECT event_type, count(*) AS months, sum(positives)::BIGINT AS positives, sum(hits)::BIGINT AS hits FROM w WHERE before < 100 AND gaps = 0 GROUP BY 1),
t AS (SELECT *, hits / positives AS share, 1.959963984540054 AS z FROM s)
SELECT event_type, months, positives, hits, round(share, 9) AS share, round(greatest(0, (share + z * z / (2 * positives)) / (1 + z * z / positives) - z * sqrt(share * (1 - share) / positives + z * z / (4 * positives * positives)) / (1 + z * z / positives)), 9) AS low,
round(least(1, (share + z * z / (2 * positives)) / (1 + z * z / positives) + z * sqrt(share * (1 - share) / positives + z * z / (4 * positives * positives)) / (1 + z * z / positives)), 9) AS high,
CASE WHEN positives < 100 THEN 'insufficient' WHEN share >= 0.5 THEN 'met' ELSE 'broken' END AS status FROM t
""")
def d13_target(spark: SparkSession, sf: str) -> DataFrame:
    """A target over the trailing window with its Wilson interval (D13, W04, A.19)."""
    day = F.date_format("ts", "yyyy-MM-dd")
    months = events(spark, sf).groupBy("event_type", day.alias("day")).agg(F.count("*").alias("positives"), F.count_if(F.col("value") > 40).alias("h"))
    months = months.withColumn("hits", F.when(~F.col("day").endswith("-08"), F.col("h")))
    out = M.target_status(months, ["event_type"], "day", "hits", "positives", 0.5)
    return out.withColumns({c: F.round(c, 9) for c in ("share", "low", "high")})


@query("""
WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (event_type = 'refund') AS failed, max(value) AS top FROM events GROUP BY 1)
SELECT day, CASE WHEN failed > 0 THEN 'failed' WHEN n = 0 THEN 'no_new_data' ELSE 'scored' END AS status, concat_ws(',', CASE WHEN top > 200 THEN 'score' END, CASE WHEN n > 340 THEN 'volume' END) AS reasons FROM d
""")
def d14_reasons(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "refund").alias("failed"), F.max("value").alias("top"))
    return days.select("day", M.month_status(F.col("n"), F.col("failed")).alias("status"), M.reasons(score=F.col("top") > 200, volume=F.col("n") > 340).alias("reasons"))


@query("""
WITH k AS (SELECT o_custkey AS k, count(*) AS n, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE count(*) FILTER (o_orderstatus = 'F') END AS hits FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, count(*) AS hits FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 3 = 0 GROUP BY 1)
SELECT k, CASE WHEN kept.n IS NULL OR (kept.hits IS NULL AND b.n IS NOT NULL) THEN b.n ELSE kept.n END AS n, CASE WHEN kept.n IS NULL OR (kept.hits IS NULL AND b.n IS NOT NULL) THEN b.hits ELSE kept.hits END AS hits FROM k kept FULL JOIN b USING (k)
""")
def d15_history_merge(spark: SparkSession, sf: str) -> DataFrame:
    from lakeward.operators.relational import history_merged

    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    filled = F.count_if(F.col("o_orderstatus") == "F")
    kept = orders.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), filled.alias("h")).select("k", "n", F.when(F.col("k") % 3 != 0, F.col("h")).alias("hits"))
    backfill = orders.where("k % 5 = 0 or k % 3 = 0").groupBy("k").agg(F.count("*").alias("n"), F.count("*").alias("hits"))
    return history_merged(kept, backfill, "k", "hits")


@query("""
WITH m AS (SELECT day(ts) AS month, max(value) > 150 AS alert, CASE WHEN day(ts) % 2 = 0 THEN day(ts) - 1 END AS labelled_month, count(*) AS labelled FROM events GROUP BY day(ts))
SELECT month::INT AS month FROM m WHERE alert AND month IN (SELECT labelled_month FROM m WHERE labelled >= 100)
""")
def d17_retrain(spark: SparkSession, sf: str) -> DataFrame:
    day = F.day("ts")
    months = table(spark, sf, "events").groupBy(day.alias("month")).agg((F.max("value") > 150).alias("alert"), F.count("*").alias("labelled"))
    months = months.withColumn("labelled_month", F.when(F.col("month") % 2 == 0, F.col("month") - 1))
    return M.retrain_months(months)


@query("""
WITH g AS (SELECT c_mktsegment, avg(c_acctbal) / 100000 AS gain, min(c_acctbal) / 1000 AS low, stddev_pop(c_acctbal) / 1e6 AS change FROM customer GROUP BY 1)
SELECT c_mktsegment, gain >= 0.02 AND low + 2 > 0 AND change >= -0.01 AS promoted, gain * 100 >= 1.0 - 1e-9 AND low >= -3.0 - 1e-9 AS kept FROM g
""")
def d18_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Promotion and version rules over one row a segment."""
    g = table(spark, sf, "customer").groupBy("c_mktsegment").agg((F.avg("c_acctbal") / 100000).alias("gain"), (F.min("c_acctbal") / 1000).alias("low"), (F.stddev_pop("c_acctbal") / 1e6).alias("change"))
    return g.select("c_mktsegment", M.promoted(F.col("gain"), F.col("low") + 2, F.col("change")).alias("promoted"), M.version_kept(F.col("gain") * 100, F.col("low")).alias("kept"))


@query("""
SELECT p_type AS key, CASE WHEN count(DISTINCT p_size % 2) = 1 THEN min(p_size % 2)::VARCHAR END AS value, count(DISTINCT p_size % 2) > 1 AS conflict FROM part GROUP BY 1
""")
def d27_merged_changes(spark: SparkSession, sf: str) -> DataFrame:
    return M.merged_changes(table(spark, sf, "part").select(F.col("p_type").alias("key"), (F.col("p_size") % 2).cast("string").alias("value")))


@query("""
WITH m AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP - INTERVAL 2 MONTHS, max(o_orderdate)::TIMESTAMP + INTERVAL 3 MONTHS, INTERVAL 1 MONTH)), '%Y-%m-01') AS month FROM orders), r AS (SELECT strftime(o_orderdate - INTERVAL 6 HOURS, '%Y-%m-01') AS month, count(*) AS runs FROM orders GROUP BY 1)
SELECT month, coalesce(runs, 0) AS runs, coalesce(runs, 0) = 0 AS missed FROM m LEFT JOIN r USING (month)
""")
def d24_missed_schedule(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    first, last = F.add_months(F.trunc(F.min("o_orderdate"), "month"), -2), F.add_months(F.max("o_orderdate").cast("date"), 3)
    months = orders.agg(first.alias("a"), last.alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return M.missed_schedule(orders, months.select(F.date_format("m", "yyyy-MM-01").alias("month")), "o_orderdate")


@query(f"""
WITH {_EV}, r AS (SELECT event_id, event_type, value, base, CASE WHEN isnan(value) OR value >= 100 THEN true ELSE false END AS flagged FROM e)
SELECT event_type, count(*) AS n, count(*) FILTER (flagged) AS flagged, round(abs(avg(value) FILTER (base) - avg(value) FILTER (NOT base)), 6) AS shift, abs(avg(value) FILTER (base) - avg(value) FILTER (NOT base)) <= 5 AS within FROM r GROUP BY 1
""")
def d25_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Review flags that count a NaN, and a tolerance between two means."""
    value = F.col("value")
    flagged = F.isnan(value) | (value >= 100)
    gap = F.abs(F.avg(F.when(F.col("base"), value)) - F.avg(F.when(~F.col("base"), value)))
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"), F.round(gap, 6).alias("shift"), (gap <= 5).alias("within"))


_SPLIT = """
WITH u AS (SELECT o_custkey, CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 'urgent' ELSE 'other' END AS stratum FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || o_custkey), o_custkey) AS p, count(*) OVER (PARTITION BY stratum) AS n FROM u)
"""


@query(_SPLIT + "SELECT o_custkey, stratum, CASE WHEN p <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN p <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5) THEN 'val' ELSE 'test' END AS split FROM r")
def r01_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified(_units(spark, sf), "o_custkey", "stratum", [("train", 0.7), ("val", 0.15), ("test", 0.15)], seed=7)


def _units(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    return first.select("o_custkey", F.when(F.col("p") == "1-URGENT", "urgent").otherwise("other").alias("stratum"))


@query(_SPLIT.replace("FROM u)", "FROM u WHERE o_custkey % 4 <> 0)") + """SELECT o_custkey, stratum, CASE WHEN p <= floor(n * 0.5::DOUBLE + 0.5) THEN 'train' ELSE 'test' END AS split FROM r
UNION ALL SELECT o_custkey, stratum, 'frozen' FROM u WHERE o_custkey % 4 = 0""")
def r02_frozen(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf)
    frozen = units.where("o_custkey % 4 = 0").select("o_custkey", F.lit("frozen").alias("split"))
    return P.frozen_split(units, frozen, "o_custkey", "stratum", [("train", 0.5), ("test", 0.5)], seed=7)


@query("SELECT event_id, user_id, (('0x' || substr(md5('3|' || user_id), 1, 1))::INT % 2)::INT AS half FROM events")
def r03_halves(spark: SparkSession, sf: str) -> DataFrame:
    return P.halves(table(spark, sf, "events").select("event_id", "user_id"), "user_id", seed=3)


@query("SELECT p_partkey FROM part ORDER BY md5('1|' || p_partkey), p_partkey LIMIT 50")
def r06_subset(spark: SparkSession, sf: str) -> DataFrame:
    return P.fixed_subset(table(spark, sf, "part").select("p_partkey"), "p_partkey", 50, seed=1)


@query("""
WITH w AS (SELECT event_id, 1.0::DOUBLE / (count(*) OVER (PARTITION BY event_type)::DOUBLE * count(*) OVER (PARTITION BY user_id)) AS w FROM events)
SELECT event_id, round(least(w, 10 * (SELECT quantile_cont(w, 0.5) FROM w)), 12) AS weight FROM w
""")
def r09_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return P.sampling_weights(rows, "event_type", "user_id").select("event_id", F.round("weight", 12).alias("weight"))


@query("""
WITH r AS (SELECT doc_id, lang, md5('2|' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('2|' || doc_id), doc_id) AS p FROM documents)
SELECT doc_id, lang FROM r ORDER BY p > 2, h, doc_id LIMIT 60
""")
def r10_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return P.at_least_per_class(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 2, 60, seed=2)


_W = "(('0x' || substr(md5(r || '|' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_POISSON = " + ".join(f"({_W} >= {v})::INT" for v in ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183", "0.999916758850712", "0.9999897508033253"))


@query(f"""
WITH u AS (SELECT event_type, user_id, count(*) FILTER (value > 50) AS t, count(*) AS b FROM events GROUP BY 1, 2), w AS (SELECT event_type, r, sum(({_POISSON}) * t) / sum(({_POISSON}) * b) AS m FROM u, range(20) AS x(r) GROUP BY ALL)
SELECT event_type, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, count(*) AS draws FROM w WHERE m IS NOT NULL GROUP BY 1
""")
def r04_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Whole users drawn again with Poisson weights from a hash."""
    units = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count_if(F.col("value") > 50).alias("t"), F.count("*").alias("b"))
    out = S.bootstrap_interval(units, ["event_type"], "user_id", "t", "b", 20)
    return out.select("event_type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "draws")


@query(f"""
WITH {_EV}, u AS (SELECT value, base, r, ('0x' || substr(md5(concat_ws('|', r, event_id)), 1, 8))::BIGINT / 4294967296.0 AS u FROM e, range(10) AS x(r) WHERE base OR period >= 5),
s AS (SELECT r, value, true AS b FROM u WHERE base AND u >= 0.5 UNION ALL SELECT r, value, false FROM u WHERE u < 0.05), c AS (SELECT r, value, count(*) FILTER (b) AS b, count(*) FILTER (NOT b) AS n FROM s GROUP BY 1, 2),
g AS (SELECT r, b, n, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY r), w AS (PARTITION BY r ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT r, max(gap) * sqrt(sum(b)::DOUBLE * sum(n) / (sum(b) + sum(n))) AS x FROM g GROUP BY 1),
p AS (SELECT CASE WHEN x < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * x * x))) END AS p FROM k),
f AS (SELECT count(*) AS n, count(*) FILTER (p < 0.05) AS h, 1.959963984540054 AS z FROM p), w AS (SELECT *, h / n AS s, 1 + z * z / n AS d FROM f)
SELECT n AS batches, h AS flagged, round(greatest(0, (s + z * z / (2 * n)) / d - z * sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / d), 6) AS low, round(least(1, (s + z * z / (2 * n)) / d + z * sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / d), 6) AS high FROM w
""")
def r07_flag_rate(spark: SparkSession, sf: str) -> DataFrame:
    """How often a KS test flags batches that mix two pools."""
    rows = events(spark, sf).where("base or period >= 5").select("event_id", "value", "base")
    reps = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("u", C.hash_share(F.col("replicate"), F.col("event_id")))
    batch = reps.where("u < 0.05").withColumn("baseline", F.lit(False))
    reference = reps.where("base and u >= 0.5").withColumn("baseline", F.lit(True))
    tested = S.drift(reference.unionByName(batch), ["replicate"], "value", "baseline")
    flags = F.count_if(F.col("p") < 0.05)
    low, high = C.wilson(flags, F.count("*"))
    return tested.agg(F.count("*").alias("batches"), flags.alias("flagged"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_CENT = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), k AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY 1)"


@query(f"WITH {_CENT}, d AS (SELECT vec_id, k.label AS nearest, list_distance(v, centroid) AS d FROM e, k) SELECT vec_id, nearest, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) = 1")
def v19_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return V.nearest(rows, V.centroids(rows, "label", "embedding"), "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_CENT} SELECT vec_id, round(list_dot_product(v, centroid) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(centroid, centroid))), 6) AS cosine, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e JOIN k USING (label)")
def v10_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine to the own class's mean, and the norm."""
    rows = table(spark, sf, "embeddings")
    joined = rows.join(V.centroids(rows, "label", "embedding"), "label")
    return joined.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"), F.round(C.norm(F.col("embedding")), 6).alias("norm"))


@query()
def v07_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Distances under a shared covariance in eight components."""
    rows = table(spark, sf, "embeddings")
    return V.mahalanobis(rows, rows.where("vec_id % 2 = 0"), "vec_id", "label", "embedding", 8)


_BOUND = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), b AS (SELECT label, i, min(x) AS low, max(x) AS high FROM e WHERE vec_id % 3 <> 0 GROUP BY 1, 2)
SELECT vec_id, round(sum(greatest(low - x, 0) / (abs(low) + 1e-6) + greatest(x - high, 0) / (abs(high) + 1e-6)), 6) AS excess FROM e JOIN b USING (label, i) GROUP BY 1
"""


@query(_BOUND)
def v09_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    limits = V.bounds(rows.where("vec_id % 3 <> 0"), "label", "embedding")
    return V.bound_excess(rows, limits, "vec_id", "label", "embedding").withColumn("excess", F.round("excess", 6))


@query("""
WITH f AS (SELECT vec_id, label, unnest(embedding[1:64])::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT vec_id, label, x, i // 16 AS block, (i % 16) // 4 AS c, i % 4 AS s FROM f),
w AS (SELECT vec_id, label, block, c, s, p, pow(x, p) AS x FROM m, range(1, 11) AS r(p)), t AS (SELECT *, sum(x) OVER (PARTITION BY vec_id, block, p, s) AS total FROM w),
g AS (SELECT vec_id, label, block, p, c, sum(x * total) AS g FROM t GROUP BY ALL), e AS (SELECT vec_id, label, block, p, c, sign(g) * pow(abs(g), 1.0::DOUBLE / p) AS x FROM g),
b AS (SELECT label, block, p, c, min(x) AS low, max(x) AS high FROM e WHERE vec_id % 3 = 0 GROUP BY ALL),
d AS (SELECT vec_id, block, sum(greatest(low - x, 0) / (abs(low) + 1e-6) + greatest(x - high, 0) / (abs(high) + 1e-6)) AS d FROM e JOIN b USING (label, block, p, c) GROUP BY ALL),
n AS (SELECT block, avg(d) + 1e-12 AS norm FROM d WHERE vec_id % 3 = 1 GROUP BY 1) SELECT vec_id, round(sum(d / norm), 5) AS score FROM d JOIN n USING (block) GROUP BY 1
""")
def v09_gram(spark: SparkSession, sf: str) -> DataFrame:
    """Gram features of four blocks at ten powers against the bounds of the vector's class,
    each block by its mean deviation on a part of its own (V09)."""
    part = F.col("vec_id") % 3
    return gram.scored(table(spark, sf, "embeddings"), part == 0, part == 1, "vec_id", "label", "embedding").withColumn("score", F.round("score", 5))


@query("""
WITH g AS (SELECT exp(ln(0.05::DOUBLE) + i * (ln(20.0::DOUBLE) - ln(0.05::DOUBLE)) / 2000) AS t FROM range(2001) AS r(i)), e AS (SELECT vec_id, label % 5 AS y, list_transform(embedding[1:5], lambda x: x::DOUBLE * 10) AS z FROM embeddings),
l AS (SELECT t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[y + 1] - list_max(z)) / t) AS nll FROM e, g WHERE vec_id % 2 = 0 GROUP BY 1), b AS (SELECT arg_min(t, nll) AS t FROM l),
s AS (SELECT u.k, u.t, y, list_transform(z, lambda x: exp((x - list_max(z)) / u.t)) AS p FROM e, (SELECT 'before' AS k, 1.0::DOUBLE AS t UNION ALL SELECT 'after', t FROM b) AS u WHERE vec_id % 2 = 1),
c AS (SELECT k, t, y, p[y + 1] / list_sum(p) AS own, list_max(p) / list_sum(p) AS top, list_position(p, list_max(p)) = y + 1 AS ok FROM s), n AS (SELECT k, t, avg(-ln(own)) AS nll FROM c GROUP BY 1, 2),
h AS (SELECT k, ceil(top * 15) AS bin, count(*) AS n, avg(top) AS c, avg(ok::INT) AS a FROM c GROUP BY 1, 2), x AS (SELECT k, sum(n * abs(a - c)) / sum(n) AS ece FROM h GROUP BY 1)
SELECT k AS which, round(t, 9) AS temperature, round(nll, 9) AS nll, round(ece, 9) AS ece FROM n JOIN x USING (k)
""")
def v03_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """The temperature of 2,001 that is likeliest on one half, and loss and calibration
    error of the other half without and with it (V03)."""
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 5).alias("y"), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10).alias("z"))
    found = temperature.fitted(rows.where("vec_id % 2 = 0"), "z", "y").select(F.lit("after").alias("which"), "temperature")
    both = found.unionByName(found.select(F.lit("before").alias("which"), F.lit(1.0).alias("temperature")))
    each = rows.where("vec_id % 2 = 1").join(F.broadcast(both), F.lit(True))  # two rows
    p = C.softmax(F.transform("z", lambda x: x / F.col("temperature")))
    each = each.select("which", "temperature", "y", p.alias("p"))
    each = each.select("which", "temperature", (-F.ln(F.element_at("p", F.col("y") + 1))).alias("loss"), F.array_max("p").alias("top"), (C.argmax(F.col("p")) == F.col("y") + 1).alias("ok"))
    ece = S.expected_calibration_error(each, ["which"], "top", "ok").select(F.col("which").alias("_which"), F.round("ece", 9).alias("ece"))
    loss = each.groupBy("which", "temperature").agg(F.round(F.avg("loss"), 9).alias("nll"))
    return loss.join(ece, F.col("which") == F.col("_which")).select("which", F.round("temperature", 9).alias("temperature"), "nll", "ece")


@query("""
WITH l AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda x: x::DOUBLE * 10) AS z, list_transform(embedding[6:10], lambda x: x::DOUBLE * 10) AS y FROM embeddings),
s AS (SELECT vec_id, label % 5 AS label, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda t: exp(t)))) AS p, list_transform(y, lambda x: exp(x) / list_sum(list_transform(y, lambda t: exp(t)))) AS q, ln(list_sum(list_transform(z, lambda t: exp(t)))) AS energy FROM l),
m AS (SELECT vec_id, label, energy, [(a + b) / 2 for a, b in list_zip(p, q)] AS e FROM s)
SELECT vec_id, round(energy, 6) AS energy, round(list_max(e), 6) AS confidence, list_position(e, list_max(e))::INT AS guess, round(-ln(e[label + 1]), 6) AS nll FROM m
""".replace("[(a + b) / 2 for a, b in list_zip(p, q)]", "list_transform(range(1, 6), lambda i: (p[i] + q[i]) / 2)"))
def v02_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax, energy, mean of two members, guess and loss."""
    logits = lambda a: F.transform(F.slice("embedding", a, 5), lambda x: x.cast("double") * 10)
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 5).alias("label"), logits(1).alias("z"), logits(6).alias("y"))
    mean = F.zip_with(C.softmax(F.col("z")), C.softmax(F.col("y")), lambda a, b: (a + b) / 2)
    rows = rows.select("vec_id", "label", C.log_sum_exp(F.col("z")).alias("energy"), mean.alias("e"))
    loss = -F.ln(F.element_at("e", F.col("label") + 1))
    return rows.select("vec_id", F.round("energy", 6).alias("energy"), F.round(F.array_max("e"), 6).alias("confidence"), C.argmax(F.col("e")).alias("guess"), F.round(loss, 6).alias("nll"))


@query("""
WITH s AS (SELECT (value % 1000) / 1000.0::DOUBLE AS c, user_id % 2 = 0 AS ok, event_type FROM events), b AS (SELECT event_type, ceil(c * 15) AS bin, count(*) AS n, avg(c) AS c, avg(ok::INT) AS a FROM s GROUP BY 1, 2)
SELECT event_type, round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM b GROUP BY 1
""")
def v03_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", ((F.col("value") % 1000) / 1000.0).alias("c"), (F.col("user_id") % 2 == 0).alias("ok"))
    return S.expected_calibration_error(rows, ["event_type"], "c", "ok").withColumn("ece", F.round("ece", 9))


@query("""
WITH p AS (SELECT value, user_id % 5 = 0 AS pos FROM events), r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k, count(*) OVER () AS n FROM p WHERE pos), t AS (SELECT max(value) AS threshold FROM r WHERE k >= ceil(n * 0.9::DOUBLE))
SELECT threshold, round(avg((value >= threshold)::INT) FILTER (pos), 9) AS sensitivity, round(avg((value < threshold)::INT) FILTER (NOT pos), 9) AS specificity, round(avg((value >= threshold)::INT), 9) AS referral FROM p, t GROUP BY 1
""")
def w13_triage(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of a wanted sensitivity and what it does."""
    rows = table(spark, sf, "events").select("value", (F.col("user_id") % 5 == 0).alias("pos"))
    referred = F.col("value") >= F.col("threshold")
    share = lambda what, where: F.round(F.avg(F.when(where, what.cast("int"))), 9)
    return rows.join(S.triage_threshold(rows, "value", "pos", 0.9), F.lit(True)).groupBy("threshold").agg(share(referred, F.col("pos")).alias("sensitivity"), share(~referred, ~F.col("pos")).alias("specificity"), share(referred, F.lit(True)).alias("referral"))


@query("""
WITH r AS (SELECT event_type, value, user_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events), c(coverage) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE))
SELECT event_type, coverage, count(*) AS kept, round(avg(ok::INT), 9) AS accuracy FROM r, c WHERE p > n - round_even(coverage * n, 0) GROUP BY ALL
""")
def w12_risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the rows kept at each coverage, the most doubtful left out first."""
    rows = table(spark, sf, "events").select("event_type", "value", "event_id", (F.col("user_id") % 3 == 0).alias("ok"))
    # Rows in order of value, doubtful ones last, ties by event_id: a row is a value of its own, however many share its score.
    one = rows.withColumn("place", F.struct(-F.col("value"), "event_id")).withColumn("c", F.lit(1))
    ranked = running(one, ["event_type"], "place", ["c"]).select("event_type", "ok", (F.col("c_before") + 1).alias("p"), F.col("c_all").alias("n"))
    grid = ranked.withColumn("coverage", F.explode(F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0))))
    kept = grid.where(F.col("p") > F.col("n") - F.bround(F.col("coverage") * F.col("n")))
    return kept.groupBy("event_type", "coverage").agg(F.count("*").alias("kept"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("accuracy"))


@query("""
WITH r AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY label ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2.0::DOUBLE AS y FROM r)
SELECT label, round(corr(x, y), 6) AS spearman FROM k GROUP BY 1
""")
def v16_spearman(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))
    x = S.mid_ranks(rows, ["label"], "a").select("label", "a", F.col("rank").alias("x"))
    y = S.mid_ranks(rows, ["label"], "b").select("label", "b", F.col("rank").alias("y"))
    return rows.join(x, ["label", "a"]).join(y, ["label", "b"]).groupBy("label").agg(F.round(F.corr("x", "y"), 6).alias("spearman"))


@query("""
WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents)
SELECT label, round((SELECT sum(n) FROM n) / (n * (SELECT count(*) FROM n))::DOUBLE, 9) AS weight FROM n
""")
def v14_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.select("label", F.round(F.sum("n").over(every) / (F.col("n") * F.count("*").over(every)).cast("double"), 9).alias("weight"))


@query("""
WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, round((n_chars - m) / d, 6) AS z, (lang = 'en')::INT AS lang_en, (lang = 'fr')::INT AS lang_fr, (lang NOT IN ('en', 'fr'))::INT AS lang_unknown FROM documents, s
""")
def v11_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised and one-hot columns, fitted on the training half only."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    fit = docs.where("doc_id % 2 = 0").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("d"))
    hot = [(F.col("lang") == v).cast("int").alias(f"lang_{v}") for v in ("en", "fr")]
    return docs.join(fit, F.lit(True)).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / F.col("d"), 6).alias("z"), *hot, (~F.col("lang").isin("en", "fr")).cast("int").alias("lang_unknown"))


@query()
def v12_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A linear probe with class weights, by held-out accuracy."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    train = rows.where("vec_id % 4 <> 0")
    counts = train.groupBy("label").agg((1.0 / F.count("*")).alias("weight"))
    model = LogisticRegression(maxIter=25, regParam=0.01, weightCol="weight").fit(train.join(counts, "label"))
    return model.transform(rows.where("vec_id % 4 = 0")).groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("recall"))


PATTERNS = {"licence": "licen[cs]e", "rights": "rights reserved", "the": "the", "und": "und"}
_FIRST = " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{k}' AS label, strpos(lower(text), lower(regexp_extract(text, '(?i){p}'))) AS pos, length(regexp_extract(text, '(?i){p}')) AS n FROM documents WHERE regexp_matches(text, '(?i){p}')" for i, (k, p) in enumerate(PATTERNS.items()))


@query(f"WITH f AS ({_FIRST}), b AS (SELECT doc_id, label FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, n DESC, place) = 1) SELECT d.doc_id, coalesce(label, 'not stated') AS label FROM documents d LEFT JOIN b USING (doc_id)")
def x02_keywords(spark: SparkSession, sf: str) -> DataFrame:
    known = {"licence": ["license", "licence"], "rights": ["rights reserved"], "the": ["the"], "und": ["und"]}
    return phrases.extracted(table(spark, sf, "documents").select("doc_id", "text"), "text", known, whole=False).drop("text")


@query(r"""
WITH v AS (SELECT item_id, lower(array_to_string(string_split_regex(trim(text), '\s+')[1:4], ' ')) AS phrase FROM benchmark WHERE trim(text) <> ''),
f AS (SELECT doc_id, item_id, strpos(lower(text), phrase) AS pos, length(phrase) AS n FROM documents, v WHERE strpos(lower(text), phrase) > 0),
b AS (SELECT doc_id, item_id FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, n DESC, item_id) = 1)
SELECT d.doc_id, coalesce(item_id::VARCHAR, 'not stated') AS label FROM documents d LEFT JOIN b USING (doc_id)
""")
def x02_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark item whose first four words come first in a text: a vocabulary of
    phrases taken from a table, in one pass over each text (X02)."""
    words = F.split(F.trim("text"), r"\s+")
    items = table(spark, sf, "benchmark").where(F.trim("text") != "").select("item_id", F.array_join(F.slice(words, 1, 4), " ").alias("phrase"))
    known = phrases.vocabulary(items, "item_id", "phrase")
    return phrases.extracted(table(spark, sf, "documents").select("doc_id", "text"), "text", known, whole=False).drop("text")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY (source = 'src0') DESC, doc_id) = 1")
def x04_one_per_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source").where("trim(text) <> ''")
    return X.one_per_text(docs, "doc_id", "text", F.col("source") == "src0").select("doc_id")


_ERR = """
WITH r AS (SELECT event_id, event_type, CASE user_id % 6 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' WHEN 2 THEN 'b1' WHEN 3 THEN 'not stated' WHEN 4 THEN 'invalid' END AS guess, CASE event_id % 4 WHEN 0 THEN 'a1' WHEN 1 THEN 'b1' WHEN 2 THEN 'a2' ELSE 'not stated' END AS truth FROM events),
k AS (SELECT *, CASE WHEN guess IS NULL OR guess = 'invalid' THEN 'invalid' WHEN guess = truth THEN 'correct' WHEN guess = 'not stated' THEN 'missed' WHEN truth = 'not stated' THEN 'invented' WHEN substr(guess, 1, 1) = substr(truth, 1, 1) THEN 'granularity' ELSE 'wrong' END AS kind FROM r)
"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.element_at(F.array(*map(F.lit, ("a1", "a2", "b1", "not stated", "invalid", None))), (F.col("user_id") % 6 + 1).cast("int"))
    truth = F.element_at(F.array(*map(F.lit, ("a1", "b1", "a2", "not stated"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", "event_type", guess.alias("guess"), truth.alias("truth"))
    return rows.withColumn("kind", X.error_kind(F.col("guess"), F.col("truth"), {"a1": "a", "a2": "a", "b1": "b"}))


@query(_ERR + "SELECT event_id, kind FROM k")
def x06_error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("event_id", "kind")


@query(_ERR + """SELECT event_type, count(*) AS n, round(avg((kind = 'correct')::INT), 9) AS accuracy, round(count(*) FILTER (kind = 'correct' AND guess <> 'not stated') / count(*) FILTER (guess <> 'not stated'), 9) AS precision,
round(count(*) FILTER (kind = 'correct' AND truth <> 'not stated') / count(*) FILTER (truth <> 'not stated'), 9) AS recall, count(*) FILTER (kind = 'missed') AS missed, count(*) FILTER (kind = 'invented') AS invented FROM k GROUP BY 1""")
def x07_score(spark: SparkSession, sf: str) -> DataFrame:
    out = X.scored(_answers(spark, sf), ["event_type"], "guess", "truth", "kind")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall")})


@query("SELECT event_id, (props::JSON ->> '$.k') AS k FROM events")
def x08_reply(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("Answer:\n"), F.col("props"), F.lit("\nDone."))
    return table(spark, sf, "events").select("event_id", X.reply_field(reply, "k").alias("k"))


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS running, sum(value) OVER w <= 300 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def x09_spend(spark: SparkSession, sf: str) -> DataFrame:
    return X.spend(table(spark, sf, "events"), "user_id", "event_id", "value", 300).select("event_id", F.round("running", 4).alias("running"), "within")


@query("""
WITH v AS (SELECT doc_id, source, CASE WHEN text IS NULL OR trim(text) = '' THEN 'unreadable' ELSE concat_ws(',', CASE WHEN length(text) < 400 THEN 'short' END, CASE WHEN length(text) > 8000 THEN 'long' END) END AS quarantine,
CASE WHEN text IS NULL OR trim(text) = '' THEN '' ELSE concat_ws(',', CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < length(text) * 0.7::DOUBLE THEN 'few_letters' END, CASE WHEN NOT contains(text, '.') THEN 'no_sentence' END) END AS flags FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (quarantine <> '') AS quarantined, count(*) FILTER (flags <> '') AS flagged, round(avg((quarantine <> '')::INT), 9) AS share, avg((quarantine <> '')::INT) > 0.1 AS spike FROM v GROUP BY 1
""")
def i04_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of an input contract and its monthly counts."""
    quarantine, flags = M.contract(F.col("text"), 400, 8000)
    verdicts = table(spark, sf, "documents").select("source", (quarantine != "").alias("q"), (flags != "").alias("f"))
    share = F.avg(F.col("q").cast("int"))
    return verdicts.groupBy("source").agg(F.count("*").alias("n"), F.count_if("q").alias("quarantined"), F.count_if("f").alias("flagged"), F.round(share, 9).alias("share"), (share > 0.1).alias("spike"))


@query("""
WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT event_id, recent, recent > 2 AS refused FROM w
""")
def b01_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a client in the day up to each, and whether they pass the limit."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    recent = F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0))
    return table(spark, sf, "events").select("event_id", "user_id", at.alias("at")).select("event_id", recent.alias("recent"), (recent > 2).alias("refused"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def b02_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by nearest rank, over the counts of distinct values."""
    counted = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return nearest_rank(counted, ["event_type"], "value", "n", [("p50", 0.5), ("p95", 0.95)]).drop("n")
