"""Replayed months, named record gates, offsets and directions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import gates as G
from lakeward.operators import statistics as S
from lakeward.operators import vectors as V
from lakeward.operators.ranks import quantile
from lakeward.operators.tables import written
from lakeward.registry import query, table

#: Records of the named gates, in expressions that Spark and DuckDB read alike.
RECORD = {
    "image_id": "event_id", "source": "CASE user_id % 5 WHEN 0 THEN 'site' ELSE 'main' END", "role": "CASE WHEN user_id % 5 = 0 THEN 'held_out' ELSE 'client' END",
    "client": "CASE WHEN user_id % 5 > 0 AND event_id % 97 <> 0 THEN concat('c', cast(user_id % 5 AS STRING)) END",
    "split": "CASE WHEN user_id % 5 = 0 AND event_id % 50 <> 0 THEN 'score' WHEN user_id % 5 = 4 AND user_id % 3 = 1 THEN 'train' WHEN user_id % 3 = 0 THEN 'test' WHEN user_id % 3 = 1 THEN 'val' ELSE 'train' END",
    "patient": "CASE WHEN user_id % 7 <> 0 THEN concat('p', cast(user_id % 200 AS STRING)) END", "label": "CASE WHEN event_id % 13 <> 0 THEN event_type END",
    "mapped": "CASE WHEN event_id % 13 <> 0 AND event_id % 31 <> 0 THEN event_type WHEN event_id % 31 = 0 THEN 'other' END", "diagnosis": "CASE event_id % 4 WHEN 0 THEN 'indeterminate' ELSE 'known' END",
}
SPLITS, UNLABELLED, DOCUMENTED = ("train", "val", "test"), ("indeterminate",), ("p10", "p20")


def named_gates(rows: DataFrame, documented: DataFrame, fingerprint: str) -> DataFrame:
    """The gates of a record table by name.

    rows: image_id, source, role, client, split, patient, label, mapped, diagnosis;
    documented: the patients that may be in several splits.
    """
    held, client = F.col("role") == "held_out", F.col("role") == "client"
    by_row = G.row_gates(rows, {
        "diagnosis_mapping_matches": (F.col("source") == "main") & G.differing(F.col("mapped"), F.col("label")),
        "site_label_rule_applied": (F.col("source") != "main") & G.allowed(F.col("diagnosis"), UNLABELLED) & F.col("label").isNotNull(),
        "every_client_image_has_a_client": client & F.col("client").isNull(), "held_out_is_only_scored": held & G.differing(F.col("split"), F.lit("score")),
    })
    lacking = G.lacking_gate(rows.where(client & F.col("client").isNotNull()), "every_client_has_all_splits", ["client"], "split", SPLITS)
    patients = rows.where("patient is not null").join(documented, "patient", "left_anti")
    return G.all_gates(
        by_row, lacking, G.group_gate(patients, "patients_in_one_split", ["patient"], F.count_distinct("split") > 1),
        G.fingerprint_gate(rows.where("source = 'main'"), "split_matches_its_fingerprint", ["image_id", "split"], fingerprint),
    )


_REC = f"rec AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORD.items())} FROM events)"


@query(f"""
WITH {_REC}, g AS (SELECT 'diagnosis_mapping_matches' AS name, count(*) AS violations FROM rec WHERE source = 'main' AND (mapped <> label OR mapped IS NULL OR label IS NULL)
UNION ALL SELECT 'site_label_rule_applied', count(*) FROM rec WHERE source <> 'main' AND diagnosis = 'indeterminate' AND label IS NOT NULL
UNION ALL SELECT 'every_client_image_has_a_client', count(*) FROM rec WHERE role = 'client' AND client IS NULL
UNION ALL SELECT 'held_out_is_only_scored', count(*) FROM rec WHERE role = 'held_out' AND split <> 'score'
UNION ALL SELECT 'every_client_has_all_splits', count(*) FROM (SELECT client FROM rec WHERE role = 'client' AND client IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) FILTER (split IN ('train', 'val', 'test')) < 3)
UNION ALL SELECT 'patients_in_one_split', count(*) FROM (SELECT patient FROM rec WHERE patient IS NOT NULL AND patient NOT IN ('p10', 'p20') GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'split_matches_its_fingerprint', 1) SELECT name, violations, violations = 0 AS passed FROM g
""")
def g08_named_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Record gates by name, with known faults."""
    rows = table(spark, sf, "events").select(*(F.expr(e).alias(n) for n, e in RECORD.items()))
    documented = spark.createDataFrame([(p,) for p in DOCUMENTED], "patient string")
    return named_gates(rows, documented, "of another split")


_GRID = [i / 10 for i in range(-5, 6)]


def _ascent_sql(classes: int, passes: int) -> str:
    """Coordinate ascent unrolled: one step after the other picks a class's offset."""
    steps, now = [], ["0.0::DOUBLE"] * classes
    for k in range(passes * classes):
        c = k % classes
        moved = ", ".join(f"z[{i + 1}] + {'off' if i == c else now[i]}" for i in range(classes))
        steps.append(
            f"s{k} AS (SELECT off FROM (SELECT off, avg(recall) AS b FROM (SELECT off, y, avg((list_position(m, list_max(m)) - 1 = y)::INT) AS recall FROM (SELECT off, y, [{moved}] AS m FROM g, o) GROUP BY 1, 2) GROUP BY 1) ORDER BY round(b, 9) DESC, abs(off), off LIMIT 1)"
        )
        now[c] = f"(SELECT off FROM s{k})"
    return f"""
WITH g AS (SELECT label % {classes} AS y, list_transform(embedding[1:{classes}], lambda x: x::DOUBLE) AS z FROM embeddings), o AS (SELECT x.i / 10.0::DOUBLE AS off FROM range(-5, 6) AS x(i)), {', '.join(steps)}
""" + " UNION ALL ".join(f"SELECT {c} AS class, {now[c]} AS off" for c in range(classes))


@query(_ascent_sql(3, 3))
def v05_offset_ascent(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of all classes by coordinate ascent, until a pass changes none."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("y"), logits.alias("z"))
    return spark.createDataFrame(list(enumerate(S.offset_ascent(rows, "y", "z", 3, _GRID))), "class int, off double")


@query("""
WITH s AS (SELECT event_type, avg(value) FILTER (day(ts) <= 10) AS base, avg(value + 5 * (event_id % 3 - 1)) FILTER (day(ts) > 10) AS mixed, avg(value * 0.9) FILTER (day(ts) > 10) AS damped, avg(value + 9) FILTER (day(ts) > 10) AS raised FROM events GROUP BY 1)
SELECT event_type, setting, round(mean - base, 6) AS change, mean < base AS wrong_way FROM (SELECT event_type, base, unnest(['mixed', 'damped', 'raised']) AS setting, unnest([mixed, damped, raised]) AS mean FROM s)
""")
def d22_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Shifted settings whose mean lies below the baseline's, though distortion should
    raise it (D22)."""
    value, base = F.col("value"), F.day("ts") <= 10
    settings = {"mixed": value + 5 * (F.col("event_id") % 3 - 1), "damped": value * 0.9, "raised": value + 9}
    shifted = [F.struct(F.lit(name).alias("setting"), F.avg(F.when(~base, v)).alias("mean")) for name, v in settings.items()]
    means = table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(base, value)).alias("base"), F.array(*shifted).alias("s"))
    return S.wrong_way(means.select("event_type", "base", F.explode("s").alias("s")).select("event_type", "base", "s.*"), "base", "mean").select(
        "event_type", "setting", F.round(F.col("mean") - F.col("base"), 6).alias("change"), "wrong_way"
    )


@query()
def v08_component_choice(spark: SparkSession, sf: str) -> DataFrame:
    """How many components hold 95 % of the variance, and which of a few sizes tells
    labels of 5 and more best from the others by Mahalanobis distance (V08)."""
    rows = table(spark, sf, "embeddings")
    train, other = rows.where("vec_id % 2 = 0 and label < 5"), rows.where("vec_id % 2 = 1")
    _, values = V.components(train, "embedding", 1)
    out = []
    for k in (2, 8, 32):
        scored = V.mahalanobis(other, train, "vec_id", "label", "embedding", k).join(other.select("vec_id", (F.col("label") >= 5).alias("far")), "vec_id")
        out.append((k, S.auroc(scored, [], "score", "far").first()["auroc"]))
    best = max(out, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(k, round(a, 9), k == best, V.components_for(values, 0.95)) for k, a in out], "size int, auroc double, chosen boolean, size_for_95 int")


REPEATS, MONTHS, START, SHARE = 4, 12, 4, 0.05
_DRAW = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT / 4294967296.0"
_REPLAY = f"""
WITH base AS (SELECT value FROM events WHERE day(ts) <= 10), pool AS (SELECT event_id, user_id, value FROM events WHERE day(ts) > 10),
d AS (SELECT r, m, event_id, user_id, value, {_DRAW.format("r, m, event_id")} AS u, {_DRAW.format("r, m, event_id, 'pick'")} AS pick FROM pool, range({REPEATS}) AS x(r), range(1, {MONTHS + 1}) AS y(m)),
a AS (SELECT 'control' AS arm, r, m, value FROM d WHERE u < {SHARE} UNION ALL SELECT 'shifted', r, m, CASE WHEN m >= {START} AND pick < 0.5 THEN value + 30 ELSE value END FROM d WHERE u < {SHARE}
  UNION ALL SELECT 'aged', r, m, value FROM d WHERE CASE WHEN m < {START} THEN u < {SHARE} WHEN user_id % 11 = 0 THEN false WHEN user_id % 4 = 0 THEN u < {SHARE} * 3 ELSE u < {SHARE} / 3 END),
z AS (SELECT DISTINCT arm, r, m FROM a), bth AS (SELECT arm, r, m, value, false AS b FROM a UNION ALL SELECT arm, r, m, value, true FROM z, base),
c AS (SELECT arm, r, m, value, count(*) FILTER (b) AS b, count(*) FILTER (NOT b) AS n FROM bth GROUP BY ALL),
g AS (SELECT arm, r, m, b, n, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY arm, r, m), w AS (PARTITION BY arm, r, m ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT arm, r, m, sum(b) AS nb, sum(n) AS n, max(gap) AS ks FROM g GROUP BY ALL), q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM base),
h AS (SELECT arm, r, m, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) FILTER (b) AS b, count(*) FILTER (NOT b) AS n FROM bth, q GROUP BY ALL),
s AS (SELECT arm, r, m, b / sum(b) OVER w + 1e-6 AS o, n / sum(n) OVER w + 1e-6 AS c FROM h WINDOW w AS (PARTITION BY arm, r, m)), psi AS (SELECT arm, r, m, sum((c - o) * ln(c / o)) AS psi FROM s GROUP BY ALL),
x AS (SELECT arm, r, m, n, ks, psi, ks * sqrt(nb::DOUBLE * n / (nb + n)) AS x FROM k JOIN psi USING (arm, r, m)),
t AS (SELECT arm, r, m, n >= 100 AND psi >= 0.2 AND (CASE WHEN x < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * x * x))) END) < 0.01 AS alert, ks FROM x),
f AS (SELECT arm, r, min(CASE WHEN alert AND m >= {START} THEN m - {START - 1} END) AS first, count(*) FILTER (alert AND m < {START}) AS early, count(*) FILTER (alert AND m >= {START}) AS later, max(ks) FILTER (m >= {START}) AS ks FROM t GROUP BY 1, 2)
SELECT arm, count(*) AS repeats, count(first) AS detected, quantile_cont(first, 0.5) AS median_months, sum(early)::BIGINT AS early_alerts, sum(later)::BIGINT AS later_alerts, round(max(ks), 6) AS largest_gap FROM f GROUP BY 1
"""


def replayed(pool: DataFrame, key: str, value: str, group: str, known: str, shift: float) -> DataFrame:
    """arm, replicate, month, value: sequences of months drawn from ``pool`` by hash,
    without replacement in a month. From month START on half of a month is shifted
    (``shifted``) or rows of ``group`` are drawn nine times as often as others, those that
    are not ``known`` being left out (``aged``). ``control`` has the same draws, unaltered."""
    grid = pool.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(MONTHS))))
    keys = F.col("replicate"), F.col("month"), F.col(key)
    # Most draws are above every share: their first digits tell before they are made numbers.
    likely = grid.where(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8) <= f"{int(SHARE * 3 * 2**32) + 1:08x}")
    drawn = likely.withColumns({"u": C.hash_share(*keys), "pick": C.hash_share(*keys, F.lit("pick"))})
    late, even = F.col("month") >= START, F.col("u") < SHARE
    mixed = F.when(~late, even).when(~F.col(known), False).when(F.col(group), F.col("u") < SHARE * 3).otherwise(F.col("u") < SHARE / 3)
    arms = F.array(
        F.struct(F.lit("control").alias("arm"), even.alias("taken"), F.col(value).alias("v")), F.struct(F.lit("aged").alias("arm"), mixed.alias("taken"), F.col(value).alias("v")),
        F.struct(F.lit("shifted").alias("arm"), even.alias("taken"), F.when(late & (F.col("pick") < 0.5), F.col(value) + shift).otherwise(F.col(value)).alias("v")),
    )
    taken = drawn.where(F.col("u") < SHARE * 3).select("replicate", "month", F.explode(F.filter(arms, lambda a: a["taken"])).alias("a"))
    return taken.select("a.arm", "replicate", "month", F.col("a.v").alias("value"))


@query(_REPLAY)
def r08_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve-month sequences with a staged shift, an age mix and a paired control: how
    many are detected, how soon, and how often nothing was there (R08)."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", F.day("ts").alias("day"))
    pool = rows.where("day > 10").select("event_id", "value", (F.col("user_id") % 4 == 0).alias("old"), (F.col("user_id") % 11 != 0).alias("known"))
    months = S.drift_against(replayed(pool, "event_id", "value", "old", "known", 30.0), ["arm", "replicate", "month"], "value", rows.where("day <= 10").select("value"))
    late = F.col("month") >= START
    runs = written(months.groupBy("arm", "replicate").agg(
        F.min(F.when(F.col("alert") & late, F.col("month") - (START - 1))).alias("first"), F.count_if(F.col("alert") & ~late).alias("early"), F.count_if(F.col("alert") & late).alias("later"), F.max(F.when(late, F.col("ks"))).alias("ks")
    ))
    out = runs.groupBy("arm").agg(F.count("*").alias("repeats"), F.count("first").alias("detected"), F.sum("early").alias("early_alerts"), F.sum("later").alias("later_alerts"), F.round(F.max("ks"), 6).alias("largest_gap"))
    return out.join(quantile(runs, ["arm"], "first", 0.5, "median_months"), "arm", "left")
