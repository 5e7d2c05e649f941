"""Queries that report: summaries of mappings, records, paired intervals, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import statistics as S
from lakeward.plans.clinical import _DERIVED, derived_mapping
from lakeward.registry import query, table

@query(f"SELECT field, count(*) AS n, count(DISTINCT concept_id) FILTER (concept_id <> 0) AS concepts, count(*) FILTER (concept_id = 0) AS without FROM {_DERIVED} GROUP BY 1")
def a34_mapping_summary(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.col("concept_id") == 0
    return derived_mapping(spark, sf).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct(F.when(~zero, F.col("concept_id"))).alias("concepts"), F.count_if(zero).alias("without"))


@query(f"SELECT DISTINCT value AS label, concept_id FROM {_DERIVED} WHERE concept_id <> 0 AND scope IN ('all', 'Brand#11') AND field LIKE 'part%'")
def x01_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The labels an answer may be chosen from."""
    usable = (F.col("concept_id") != 0) & F.col("scope").isin("all", "Brand#11") & F.col("field").startswith("part")
    return derived_mapping(spark, sf).where(usable).select(F.col("value").alias("label"), "concept_id").distinct()


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, (props::JSON ->> '$.k')::INT * 2 AS twice FROM events WHERE (props::JSON ->> '$.k')::INT IS NOT NULL")
def p02_struct_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """A struct's fields as columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    decoded = table(spark, sf, "events").select("event_id", F.struct(k.alias("k"), (k * 2).alias("twice")).alias("d"))
    return decoded.where("d.k is not null").select("event_id", "d.*")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(idiot|stupid)\\b') THEN 'yes' ELSE 'no' END AS confirmed FROM documents")
def x03_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmation by a word list."""
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("text").rlike(r"(?i)\b(idiot|stupid)\b"), "yes").otherwise("no").alias("confirmed"))


@query("""
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS truth, CASE WHEN o_orderpriority < '3' THEN 'F' ELSE 'O' END AS guess FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT month, truth, count(*) AS n, avg((truth = guess)::INT) AS recall FROM r GROUP BY 1, 2), m AS (SELECT month, sum(n)::BIGINT AS labelled, count(*) AS classes, avg(recall) AS b FROM c GROUP BY 1)
SELECT month, labelled, classes, CASE WHEN labelled >= 100 THEN round(b, 9) END AS balanced_accuracy, CASE WHEN labelled < 100 THEN 'insufficient' WHEN b >= 0.55 THEN 'met' ELSE 'broken' END AS status FROM m
""")
def a31_delayed_record(spark: SparkSession, sf: str) -> DataFrame:
    """Each month's accuracy once its labels are there."""
    guess = F.when(F.col("o_orderpriority") < "3", "F").otherwise("O")
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("truth"), guess.alias("guess"))
    out = S.classification(rows, ["month"], "truth", "guess")
    enough, b = F.col("n") >= 100, F.col("balanced_accuracy")
    status = F.when(~enough, "insufficient").when(b >= 0.55, "met").otherwise("broken")
    return out.select("month", F.col("n").alias("labelled"), "classes", F.when(enough, F.round(b, 9)).alias("balanced_accuracy"), status.alias("status"))


@query("""
WITH j AS (SELECT event_id, to_json({'delayed': {'month': day(ts), 'n': user_id}})::VARCHAR AS record FROM events)
SELECT (record::JSON ->> '$.delayed.month')::INT AS month, sum((record::JSON ->> '$.delayed.n')::BIGINT)::BIGINT AS n FROM j GROUP BY 1
""")
def d16_rekeyed(spark: SparkSession, sf: str) -> DataFrame:
    """Records re-keyed by the month that they describe."""
    record = F.to_json(F.struct(F.struct(F.day("ts").alias("month"), F.col("user_id").alias("n")).alias("delayed")))
    rows = table(spark, sf, "events").select(record.alias("record"))
    parsed = F.from_json("record", "delayed struct<month: int, n: bigint>")["delayed"]
    return rows.select(parsed["month"].alias("month"), parsed["n"].alias("n")).groupBy("month").agg(F.sum("n").alias("n"))


@query("""
WITH s AS (SELECT label % 2 AS grp, label >= 5 AS pos, unnest([0, 1]) AS detector, embedding FROM embeddings), v AS (SELECT grp, detector, pos, embedding[detector + 1]::DOUBLE AS x FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY grp, detector ORDER BY x) + (count(*) OVER (PARTITION BY grp, detector, x) - 1) / 2.0::DOUBLE AS r FROM v),
a AS (SELECT grp, detector, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auroc FROM r GROUP BY 1, 2),
q AS (SELECT grp, detector, quantile_cont(x, 0.95) FILTER (NOT pos) AS cut FROM v GROUP BY 1, 2), f AS (SELECT v.grp, v.detector, avg((x <= cut)::INT) AS fpr FROM v JOIN q USING (grp, detector) WHERE pos GROUP BY 1, 2)
SELECT a.grp, a.detector, round(auroc, 9) AS auroc, round(fpr, 9) AS fpr, auroc < 0.5 AS implausible FROM a JOIN f USING (grp, detector)
""")
def v13_detector_table(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors by shift: AUROC, FPR at 95 % and implausible values."""
    scores = F.posexplode(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))).alias("detector", "x")
    rows = table(spark, sf, "embeddings").select((F.col("label") % 2).alias("grp"), (F.col("label") >= 5).alias("pos"), scores)
    keys = ["grp", "detector"]
    both = S.auroc(rows, keys, "x", "pos").join(S.false_positive_rate(rows, keys, "x", "pos"), keys)
    return both.select(*keys, F.round("auroc", 9).alias("auroc"), F.round("fpr", 9).alias("fpr"), (F.col("auroc") < 0.5).alias("implausible"))


_W = "(('0x' || substr(md5(r || '|' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_POISSON = " + ".join(f"({_W} >= {v})::INT" for v in ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183", "0.999916758850712", "0.9999897508033253"))


@query(f"""
WITH u AS (SELECT event_type, user_id, count(*) FILTER (value > 50) - count(*) FILTER (value > 60) AS gain, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT event_type, r, sum(({_POISSON}) * gain) / sum(({_POISSON}) * n) AS m FROM u, range(20) AS x(r) GROUP BY 1, 2)
SELECT event_type, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, quantile_cont(m, 0.025) > 0 AS better FROM w GROUP BY 1
""")
def r05_paired(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of a difference of two models on the same draws."""
    hits = lambda cut: F.count_if(F.col("value") > cut)
    units = table(spark, sf, "events").groupBy("event_type", "user_id").agg((hits(50) - hits(60)).alias("gain"), F.count("*").alias("n"))
    out = S.bootstrap_interval(units, ["event_type"], "user_id", "gain", "n", 20)
    return out.select("event_type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), (F.col("low") > 0).alias("better"))


@query("""
WITH g AS (SELECT vec_id, label % 3 AS y, embedding[1:3] AS v FROM embeddings), o AS (SELECT x.i / 10.0::DOUBLE AS off FROM range(-5, 6) AS x(i)),
p AS (SELECT off, y, list_position([v[1]::DOUBLE + off, v[2]::DOUBLE, v[3]::DOUBLE], list_max([v[1]::DOUBLE + off, v[2]::DOUBLE, v[3]::DOUBLE])) - 1 AS guess FROM g, o), c AS (SELECT off, y, avg((guess = y)::INT) AS recall FROM p GROUP BY 1, 2), b AS (SELECT off, avg(recall) AS b FROM c GROUP BY 1)
SELECT off, round(b, 9) AS balanced_accuracy, row_number() OVER (ORDER BY round(b, 9) DESC, off) = 1 AS chosen FROM b
""")
def v05_offset_grid(spark: SparkSession, sf: str) -> DataFrame:
    """One step of the offset search: a class's offset over a grid, in one pass."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    grid = F.explode(F.array(*(F.lit(i / 10.0) for i in range(-5, 6))))
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("y"), logits.alias("z"), grid.alias("off"))
    moved = F.transform("z", lambda x, i: F.when(i == 0, x + F.col("off")).otherwise(x))
    out = S.classification(rows.select("off", "y", (C.argmax(moved) - 1).alias("guess")), ["off"], "y", "guess").select("off", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))
    # One row for each value of the grid.
    return out.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("balanced_accuracy"), "off")) == 1)
