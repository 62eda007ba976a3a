"""Checks of the metric, process, state and trend operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.checks import inputs as i
from opsdiff.checks.base import check, near, rounded
from opsdiff.functions import judge as j
from opsdiff.operators import dedupe, diff, proc, rules, state, trend, triage, windows
from opsdiff.operators.chunks import DAY
from opsdiff.plans import reports
from opsdiff.session import shared_dir
from opsdiff.sources.catalog import builtin_catalog, resource_of
from opsdiff.sources.rules import builtin_rules


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.window_diff(i.samples(spark, sf_dir), builtin_catalog(spark), i.HALVES)


# ---- scans and means -------------------------------------------------------


@check("scan_window", f"WITH {i.SAMPLES} SELECT host, ts, metric, instance, value, units FROM samples "
       f"WHERE ts >= {i.sql_ts(i.HALVES.b_start)} AND ts < {i.sql_ts(i.HALVES.b_end)} AND metric NOT LIKE 'site.%'")
def scan_window(spark, sf_dir):
    catalog = builtin_catalog(spark)
    return windows.scan_window(
        i.samples(spark, sf_dir), i.HALVES.b_start, i.HALVES.b_end, catalog.names
    )


@check("window_means", f"WITH {i.SAMPLES} SELECT host, metric, instance, round(avg(value) + 3e-8, 4) AS val FROM samples GROUP BY ALL")
def window_means(spark, sf_dir):
    return rounded(windows.window_means(i.samples(spark, sf_dir), *i.MONTH), "val")


@check("time_weighted_means", f"""WITH {i.SAMPLES},
held AS (SELECT *, epoch_us(coalesce(lead(ts) OVER (PARTITION BY host, metric, instance ORDER BY ts),
                            {i.sql_ts(i.MONTH[1])})) - epoch_us(ts) AS us FROM samples)
SELECT host, metric, instance, round(sum(value * us) / sum(us) + 3e-8, 4) AS val FROM held GROUP BY ALL""")
def time_weighted_means(spark, sf_dir):
    return rounded(windows.time_weighted_means(i.samples(spark, sf_dir), *i.MONTH, DAY), "val")


@check("counter_rates", f"""WITH {i.SAMPLES},
steps AS (SELECT *, value - lag(value) OVER w AS dv, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us
          FROM samples WINDOW w AS (PARTITION BY host, metric, instance ORDER BY ts))
SELECT host, metric, instance, round(sum(dv) / sum(us) * 1e6 * 3600 + 3e-8, 4) AS per_hour
FROM steps WHERE dv >= 0 GROUP BY ALL""")
def counter_rates(spark, sf_dir):
    rates = windows.counter_rates(i.samples(spark, sf_dir), chunk=DAY)
    return rates.select("host", "metric", "instance", near(F.col("val") * 3600).alias("per_hour"))


@check("mixed_kinds", f"""WITH {i.SAMPLES}, kinds AS (SELECT *, metric LIKE '%bytes' AS counter FROM samples),
plain AS (SELECT * FROM kinds WHERE NOT counter), {i.means_sql(i.HALVES, 'plain')},
sided AS (SELECT *, ts >= {i.sql_ts(i.HALVES.b_start)} AS in_b FROM kinds WHERE counter),
steps AS (SELECT *, value - lag(value) OVER w AS dv, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us
          FROM sided WINDOW w AS (PARTITION BY host, metric, instance, in_b ORDER BY ts)),
rates AS (SELECT host, metric, instance, units, in_b, sum(dv) / sum(us) * 1e6 AS val FROM steps WHERE dv >= 0 GROUP BY ALL)
SELECT host, metric, instance, units, round(a + 3e-8, 4) AS a, round(b + 3e-8, 4) AS b FROM means
UNION ALL
SELECT host, metric, instance, units, round(max(CASE WHEN NOT in_b THEN val END) + 3e-8, 4), round(max(CASE WHEN in_b THEN val END) + 3e-8, 4)
FROM rates GROUP BY ALL""")
def mixed_kinds(spark, sf_dir):
    kind = F.when(F.col("metric").endswith("bytes"), "counter").otherwise("instant")
    means = windows.paired_means(i.samples(spark, sf_dir).withColumn("kind", kind), i.HALVES)
    return rounded(means, "a", "b").drop("threshold_pct")


# ---- regression diff -------------------------------------------------------

ROW_COLUMNS = """host, metric, instance, label, category, units, round(a + 3e-8, 4) AS a, round(b + 3e-8, 4) AS b,
round(delta_pct + 3e-8, 4) AS delta_pct, exceeded, verdict, kind, core, fold, cat_idx, metric_idx"""


@check("window_diff", i.DIFF + f"SELECT {ROW_COLUMNS} FROM rows_")
def window_diff(spark, sf_dir):
    return rounded(diff_rows(spark, sf_dir), "a", "b", "delta_pct")


@check("window_diff_per_host", "WITH " + ", ".join([
    i.SAMPLES, i.CATALOG,
    "w AS (SELECT host, TIMESTAMP '2024-01-01' AS a_start, TIMESTAMP '2024-01-02' + to_days(substr(host, 2)::INT + 10) AS mid FROM (SELECT DISTINCT host FROM samples))",
    """means AS (SELECT s.host, s.metric, s.instance, max(units) AS units,
       avg(value) FILTER (WHERE ts < mid) AS a, avg(value) FILTER (WHERE ts >= mid) AS b
       FROM samples s JOIN w ON s.host = w.host GROUP BY ALL)""",
    i.ROWS.replace("ELSE 15 END", "ELSE 15 + substr(host, 2)::INT END"),
]) + f" SELECT {ROW_COLUMNS} FROM rows_")
def window_diff_per_host(spark, sf_dir):
    samples = i.samples(spark, sf_dir)
    n = F.substring("host", 2, 9).cast("int")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    mid = start + F.make_dt_interval(days=n + 11)
    per_host = samples.select("host").distinct().select(
        "host", start.alias("a_start"), mid.alias("a_end"), mid.alias("b_start"),
        F.lit("2024-01-31").cast("timestamp_ntz").alias("b_end"),
        (n + 15).cast("double").alias("threshold_pct"),
    )
    return rounded(
        diff.window_diff(samples, builtin_catalog(spark), per_host), "a", "b", "delta_pct"
    )


@check("means_diff", i.DIFF + f"SELECT {ROW_COLUMNS.replace('units, ', '')} FROM rows_")
def means_diff(spark, sf_dir):
    samples, w = i.samples(spark, sf_dir), i.HALVES

    def side(start, end):
        return windows.window_means(samples, start, end).withColumn("units", F.lit(""))

    rows = diff.means_diff(
        side(w.a_start, w.a_end), side(w.b_start, w.b_end), builtin_catalog(spark), 15.0
    )
    return rounded(rows, "a", "b", "delta_pct").drop("units")


PAIRS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
  CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity < 5 THEN 0 ELSE l_quantity - 25 END AS a,
  CASE WHEN l_tax > 0.07 THEN NULL WHEN l_tax < 0.01 THEN 0 ELSE l_extendedprice / 1000 - 25 END AS b,
  CASE l_linenumber % 3 WHEN 0 THEN 'worse_up' WHEN 1 THEN 'better_up' ELSE 'neutral' END AS polarity,
  l_discount * 1000 AS threshold, CASE WHEN l_linenumber > 4 THEN 20.0 ELSE 0.0 END AS min_abs FROM lineitem"""


def pairs_of(spark, sf_dir):
    lines = i.table(spark, sf_dir, "lineitem")
    n, q, tax = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax")
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        F.when(q > 45, None).when(q < 5, 0.0).otherwise(q - 25).alias("a"),
        F.when(tax > 0.07, None).when(tax < 0.01, 0.0)
        .otherwise(F.col("l_extendedprice") / 1000 - 25).alias("b"),
        F.when(n % 3 == 0, "worse_up").when(n % 3 == 1, "better_up").otherwise("neutral").alias("polarity"),
        (F.col("l_discount") * 1000).alias("threshold"),
        F.when(n > 4, 20.0).otherwise(0.0).alias("min_abs"),
    )


@check("judge", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(delta_pct + 3e-8, 4) AS delta_pct, exceeded, verdict,
  CASE WHEN a IS NULL AND b IS NOT NULL THEN 'new' WHEN b IS NULL AND a IS NOT NULL THEN 'gone' ELSE verdict END AS kind
FROM (SELECT *, {i.judge_sql('threshold')} FROM ({PAIRS}))""")
def judge(spark, sf_dir):
    c = F.col
    verdict = j.judge(c("a"), c("b"), c("polarity"), c("threshold"), c("min_abs"))
    return pairs_of(spark, sf_dir).withColumn("j", verdict).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        near("j.delta_pct").alias("delta_pct"), "j.exceeded", "j.verdict",
        j.row_kind(c("a"), c("b"), c("j.verdict")).alias("kind"),
    )


@check("change_weights", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(coalesce(abs(delta_pct), 1e18) + 3e-8, 4) AS triage_weight,
  round(CASE WHEN delta_pct IS NOT NULL THEN abs(delta_pct) WHEN a IS NULL OR b IS NULL THEN 1e300 ELSE 0 END + 3e-8, 4) AS display_weight
FROM (SELECT *, {i.judge_sql('threshold')} FROM ({PAIRS}))""")
def change_weights(spark, sf_dir):
    delta = j.pct_change(F.col("a"), F.col("b"))
    return pairs_of(spark, sf_dir).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        near(j.triage_weight(delta)).alias("triage_weight"),
        near(F.least(j.display_weight(delta, F.col("a"), F.col("b")), F.lit(1e300))).alias("display_weight"),
    )


@check("focus", i.DIFF + "SELECT host, metric, instance, kind FROM rows_ WHERE kind <> 'flat'")
def focus(spark, sf_dir):
    return diff.focus(diff_rows(spark, sf_dir)).select("host", "metric", "instance", "kind")


@check("verdict_counts", i.DIFF + "SELECT host, " + ", ".join(
    f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in j.ROW_KINDS) + " FROM rows_ GROUP BY host")
def verdict_counts(spark, sf_dir):
    return diff.verdict_counts(diff_rows(spark, sf_dir))


@check("category_counts", i.DIFF + "SELECT host, category, count(*) AS items FROM rows_ WHERE kind <> 'flat' GROUP BY ALL")
def category_counts(spark, sf_dir):
    return diff.category_counts(diff.focus(diff_rows(spark, sf_dir)))


@check("magnitude_bars", i.DIFF + """SELECT host, metric, instance, round(scale + 3e-8, 4) AS scale, CASE WHEN delta_pct IS NOT NULL THEN round(least(50, abs(delta_pct) / scale * 50) + 3e-8, 4) END AS bar
FROM (SELECT *, greatest(100, max(abs(delta_pct)) OVER (PARTITION BY host)) AS scale FROM rows_)""")
def magnitude_bars(spark, sf_dir):
    return rounded(diff.with_bars(diff_rows(spark, sf_dir)), "scale", "bar").select(
        "host", "metric", "instance", "scale", "bar"
    )


@check("top_worst", i.DIFF + """SELECT host, rank::INT AS rank, metric, instance, round(delta_pct + 3e-8, 4) AS delta_pct
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY coalesce(abs(delta_pct), 0) DESC, cat_idx, metric_idx, instance) AS rank
      FROM rows_ WHERE kind = 'worse') WHERE rank <= 5""")
def top_worst(spark, sf_dir):
    return rounded(diff.top_worst(diff_rows(spark, sf_dir)), "delta_pct").select(
        "host", "rank", "metric", "instance", "delta_pct"
    )


@check("fold_instances", i.DIFF + """, ranked AS (
  SELECT *, count(*) OVER (PARTITION BY host, metric) AS n, row_number() OVER (PARTITION BY host, metric ORDER BY
    CASE kind WHEN 'worse' THEN 0 WHEN 'new' THEN 1 WHEN 'watch' THEN 2 WHEN 'gone' THEN 3 WHEN 'better' THEN 4 ELSE 5 END,
    coalesce(abs(delta_pct), CASE WHEN a IS NULL OR b IS NULL THEN 'inf'::DOUBLE ELSE 0 END) DESC, instance) AS rn,
    min(b) OVER (PARTITION BY host, metric) AS lo, max(b) OVER (PARTITION BY host, metric) AS hi FROM rows_)
SELECT host, metric, n AS instances, instance, kind, round(delta_pct + 3e-8, 4) AS delta_pct, round(lo + 3e-8, 4) AS b_min, round(hi + 3e-8, 4) AS b_max
FROM ranked WHERE fold AND n > 4 AND rn = 1
UNION ALL SELECT host, metric, 1, instance, kind, round(delta_pct + 3e-8, 4), round(b + 3e-8, 4), round(b + 3e-8, 4) FROM ranked WHERE NOT (fold AND n > 4)""")
def fold_instances(spark, sf_dir):
    return rounded(diff.fold_instances(diff_rows(spark, sf_dir)), "delta_pct", "b_min", "b_max").select(
        "host", "metric", "instances", "instance", "kind", "delta_pct", "b_min", "b_max"
    )


@check("resource_blocks", i.DIFF + """SELECT category, CASE category WHEN 'CPU' THEN 'cpu' WHEN 'Memory' THEN 'mem'
  WHEN 'Disk I/O' THEN 'disk' WHEN 'Filesystem' THEN 'disk' WHEN 'Network' THEN 'net' ELSE 'other' END AS res, core, count(*) AS n
FROM rows_ GROUP BY ALL""")
def resource_blocks(spark, sf_dir):
    rows = diff_rows(spark, sf_dir).withColumn("res", resource_of(F.col("category")))
    return rows.groupBy("category", "res", "core").agg(F.count("*").alias("n"))


# ---- rules and triage ------------------------------------------------------

_HITS = """, hits AS (
  SELECT r.host, u.rule_idx, u.id, u.severity, u.n_conds, u.cond_idx, r.metric, r.instance, r.cat_idx, r.metric_idx, r.a, r.b, r.delta_pct
  FROM rows_ r JOIN rules u ON r.metric = u.metric
  WHERE (u.verdict = '' OR r.verdict = u.verdict) AND (NOT u.appeared OR (r.a IS NULL AND r.b IS NOT NULL))
    AND (NOT u.b_gt_zero OR r.b > 0) AND (u.b_gte IS NULL OR r.b >= u.b_gte)
    AND (u.delta_gte IS NULL OR r.delta_pct >= u.delta_gte) AND (u.delta_lte IS NULL OR r.delta_pct <= u.delta_lte)),
first_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, rule_idx, cond_idx ORDER BY cat_idx, metric_idx, instance) AS rn FROM hits) WHERE rn = 1),
findings AS (
  SELECT host, rule_idx, id, severity, string_agg(metric || '[' || instance || ']', ' ' ORDER BY cond_idx) AS evidence
  FROM first_hits GROUP BY ALL HAVING count(*) = max(n_conds)) """


@check("rule_hits", i.DIFF_RULES + _HITS + "SELECT host, rule_idx, cond_idx, metric, instance FROM hits")
def rule_hits(spark, sf_dir):
    return rules.rule_hits(diff_rows(spark, sf_dir), builtin_rules(spark)).select(
        "host", "rule_idx", "cond_idx", "metric", "instance"
    )


@check("first_hits", i.DIFF_RULES + _HITS + "SELECT host, rule_idx, cond_idx, metric, instance, round(delta_pct + 3e-8, 4) AS delta_pct FROM first_hits")
def first_hits(spark, sf_dir):
    return rules.first_hits(diff_rows(spark, sf_dir), builtin_rules(spark)).select(
        "host", "rule_idx", "cond_idx", "hit.metric", "hit.instance",
        near("hit.delta_pct").alias("delta_pct"),
    )


@check("findings", i.DIFF_RULES + _HITS + """SELECT host, rule_idx, id, severity,
  CASE severity WHEN 'crit' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS severity_rank, evidence FROM findings""")
def findings(spark, sf_dir):
    # Numbers are cut from the evidence: their last shown digit may differ between engines.
    bare = F.transform("evidence", lambda e: F.regexp_replace(e, " .*$", ""))
    named = F.transform(bare, lambda e: F.when(e.endswith("]"), e).otherwise(F.concat(e, F.lit("[]"))))
    return rules.findings(diff_rows(spark, sf_dir), builtin_rules(spark)).select(
        "host", "rule_idx", "id", "severity", "severity_rank", F.array_join(named, " ").alias("evidence")
    )


_BOARD = """, cand AS (
  SELECT *, CASE category WHEN 'CPU' THEN 'cpu' WHEN 'Memory' THEN 'mem' WHEN 'Disk I/O' THEN 'disk' WHEN 'Filesystem' THEN 'disk'
                 WHEN 'Network' THEN 'net' END AS res,
    CASE WHEN verdict = 'worse' AND core THEN 0
         WHEN verdict = 'worse' AND a IS NOT NULL AND b IS NOT NULL THEN 1
         WHEN verdict = 'watch' AND (core OR (a IS NOT NULL AND b IS NOT NULL)) THEN 1 END AS cls FROM rows_),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, res ORDER BY cls,
      CASE WHEN cls = 0 THEN coalesce(abs(delta_pct), 1e18) ELSE 0 END DESC, cat_idx, metric_idx, instance) AS rn
    FROM cand WHERE cls IS NOT NULL) WHERE rn = 1),
board AS (
  SELECT h.host, k.pos, k.key, k.label, CASE WHEN cls = 0 THEN 'bad' WHEN cls = 1 THEN 'warn' ELSE 'ok' END AS status,
    CASE WHEN cls IS NULL THEN 'normal' ELSE b.label || CASE WHEN instance <> '' THEN '[' || instance || ']' ELSE '' END || ' ' ||
      CASE WHEN delta_pct IS NOT NULL THEN CASE WHEN delta_pct < 0 THEN '' ELSE '+' END ||
             CASE WHEN abs(delta_pct) > 999 THEN 'spike' ELSE trunc(delta_pct)::INT || '%' END
           WHEN b.a IS NULL AND b.b IS NOT NULL THEN 'appeared' ELSE 'anomaly' END END AS headline,
    round(delta_pct + 3e-8, 4) AS worst_pct
  FROM (SELECT DISTINCT host FROM rows_) h
  CROSS JOIN (VALUES (0, 'cpu', 'CPU'), (1, 'mem', 'Memory'), (2, 'disk', 'Disk'), (3, 'net', 'Network')) k(pos, key, label)
  LEFT JOIN best b ON b.host = h.host AND b.res = k.key)"""
_SOFTWARE = """SELECT h.host, 4 AS pos, 'software' AS key, 'Software' AS label,
  CASE WHEN coalesce(crit, 0) > 0 THEN 'bad' WHEN coalesce(n, 0) > 0 THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN coalesce(n, 0) > 0 THEN n || ' finding(s)' ELSE 'nothing found' END AS headline, NULL::DOUBLE AS worst_pct
FROM (SELECT DISTINCT host FROM rows_) h LEFT JOIN
  (SELECT host, count(*) AS n, count(*) FILTER (WHERE severity = 'crit') AS crit FROM findings GROUP BY host) f ON f.host = h.host"""


@check("triage", i.DIFF.rstrip() + _BOARD + " SELECT * FROM board")
def triage_board(spark, sf_dir):
    return rounded(triage.triage(diff_rows(spark, sf_dir)), "worst_pct")


@check("software_block", i.DIFF_RULES + _HITS + _SOFTWARE)
def software_block(spark, sf_dir):
    rows = diff_rows(spark, sf_dir)
    return rules.software_block(
        rules.findings(rows, builtin_rules(spark)), rows.select("host").distinct()
    )


@check("regressed", i.DIFF_RULES + _HITS + """SELECT host, bool_or(flag) AS regressed FROM (
  SELECT host, verdict = 'worse' AS flag FROM rows_ UNION ALL SELECT host, severity = 'crit' FROM findings) GROUP BY host""")
def regressed(spark, sf_dir):
    rows = diff_rows(spark, sf_dir)
    return diff.regressed(rows, rules.findings(rows, builtin_rules(spark)))


@check("compare_report", i.DIFF_RULES + _HITS + _BOARD + f""", full_board AS (SELECT * FROM board UNION ALL {_SOFTWARE}),
counts AS (SELECT host, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in j.ROW_KINDS)} FROM rows_ GROUP BY host),
missing AS (SELECT host, {len(i.METRICS) - len(i.UNLISTED)} - count(DISTINCT metric) AS n_missing FROM rows_ GROUP BY host),
flags AS (SELECT host, bool_or(flag) AS regressed FROM (
  SELECT host, verdict = 'worse' AS flag FROM rows_ UNION ALL SELECT host, severity = 'crit' FROM findings) GROUP BY host)
SELECT b.*, c.* EXCLUDE (host), m.n_missing, f.regressed FROM full_board b JOIN counts c ON b.host = c.host
  JOIN missing m ON b.host = m.host JOIN flags f ON b.host = f.host""")
def compare_report(spark, sf_dir):
    report = reports.compare(
        i.samples(spark, sf_dir), i.HALVES, keep=shared_dir(spark, "diff-rows")
    )
    missing = report.missing.groupBy("host").agg(F.count("*").alias("n"))
    return (
        rounded(report.triage, "worst_pct")
        .join(report.counts, "host")
        .join(missing, "host", "left")
        .join(report.regressed, "host")
        .withColumn("n_missing", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


# ---- distinct, duplicates, coverage ----------------------------------------


@check("missing_metrics", f"""WITH {i.PRESETS}, per_user AS (SELECT 'u' || user_id AS host, ({i.sql_list(i.METRICS)})[event_id % {len(i.METRICS)} + 1] AS metric FROM events)
SELECT h.host, p.metric FROM (SELECT DISTINCT host FROM per_user) h CROSS JOIN (SELECT DISTINCT metric FROM presets) p
EXCEPT SELECT host, metric FROM per_user""")
def missing_metrics(spark, sf_dir):
    # A host for each user: no user has all metrics.
    names = F.array(*[F.lit(m) for m in i.METRICS])
    per_user = i.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), "ts",
        F.get(names, (F.col("event_id") % len(i.METRICS)).cast("int")).alias("metric"), F.lit("").alias("instance"), "value",
    )
    return trend.trend_missing(per_user, builtin_catalog(spark).presets, *i.MONTH)


@check("missing_catalog_metrics", f"""WITH {i.SAMPLES}, {i.CATALOG}, per_user AS (SELECT * REPLACE ('u' || s.user_id AS host) FROM
  (SELECT e.user_id, x.* FROM events e, LATERAL (SELECT ({i.sql_list(i.METRICS)})[e.event_id % {len(i.METRICS)} + 1] AS metric, '' AS host) x) s)
SELECT h.host, c.metric FROM (SELECT DISTINCT host FROM per_user) h CROSS JOIN catalog c
EXCEPT SELECT host, metric FROM per_user""")
def missing_catalog_metrics(spark, sf_dir):
    events = i.table(spark, sf_dir, "events")
    names = F.array(*[F.lit(m) for m in i.METRICS])
    per_user = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
        F.get(names, (F.col("event_id") % len(i.METRICS)).cast("int")).alias("metric"),
    )
    return dedupe.missing_catalog_metrics(per_user, builtin_catalog(spark))


@check("coverage", f"""WITH {i.SAMPLES} SELECT DISTINCT host,
  CASE WHEN length(metric) % 2 = 0 THEN metric ELSE 'Cannot read ' || metric END AS metric FROM samples""")
def coverage(spark, sf_dir):
    metric = F.col("metric")
    warnings = i.samples(spark, sf_dir).select(
        "host",
        F.when(F.length(metric) % 2 == 0, F.concat(F.lit("Error for "), metric, F.lit(": unknown")))
        .otherwise(F.concat(F.lit("Cannot read "), metric)).alias("warning"),
    )
    return dedupe.coverage(warnings)


@check("dedupe_first", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def dedupe_first(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return dedupe.dedupe_first(orders, ["o_custkey", "o_orderpriority"], "o_orderkey")


@check("dedupe_last", "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def dedupe_last(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return dedupe.dedupe_last(orders, ["o_custkey", "o_orderpriority"], "o_orderkey")


@check("union_keys", "SELECT l_partkey AS k, l_suppkey AS s FROM lineitem UNION SELECT o_custkey, o_orderkey FROM orders")
def union_keys(spark, sf_dir):
    return dedupe.union_keys(
        i.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")),
        i.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("s")),
        ["k", "s"],
    )


_WARNINGS = """SELECT host, warning, min(part * 1000000000 + seq) // 1000000000 AS part, min(part * 1000000000 + seq) % 1000000000 AS seq FROM (
  SELECT 'h' || (user_id % 8) AS host, 0 AS part, event_id AS seq, event_type || ' ' || (user_id % 5) AS warning FROM events WHERE value < 20
  UNION ALL SELECT 'h' || (user_id % 8), 1, event_id, event_type || ' ' || (user_id % 7) FROM events WHERE value >= 20) GROUP BY ALL"""


def _warnings(spark, sf_dir):
    events = i.table(spark, sf_dir, "events")

    def part(rows, n):
        return rows.select(
            F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"), F.col("event_id").alias("seq"),
            F.concat_ws(" ", "event_type", (F.col("user_id") % n).cast("string")).alias("warning"),
        )

    return [part(events.where("value < 20"), 5), part(events.where("value >= 20"), 7)]


def _in_parts(merged):
    return merged.select("host", "warning", F.col("seen.part").cast("bigint").alias("part"), "seen.seq")


@check("union_warnings", _WARNINGS)
def union_warnings(spark, sf_dir):
    return _in_parts(dedupe.union_warnings(*_warnings(spark, sf_dir)))


@check("report_warnings", f"SELECT report, w.* FROM ({_WARNINGS}) w, (VALUES ('metrics'), ('processes')) r(report)")
def report_warnings(spark, sf_dir):
    warnings = _warnings(spark, sf_dir)
    metrics = reports.compare(i.samples(spark, sf_dir), i.HALVES, warnings=warnings).warnings
    processes = reports.proc_report(i.proc_samples_in(spark, sf_dir), i.PROC_WINDOWS, warnings=warnings).warnings
    both = _in_parts(metrics).withColumn("report", F.lit("metrics"))
    return both.unionByName(_in_parts(processes).withColumn("report", F.lit("processes")))


# ---- processes -------------------------------------------------------------


def proc_rows(spark, sf_dir):
    return proc.proc_diff(i.proc_samples_in(spark, sf_dir), i.PROC_WINDOWS)


@check("proc_samples", f"""WITH {i.PROC_SAMPLES}, means AS (SELECT host, metric, instance, avg(value) AS a, NULL::DOUBLE AS b FROM proc GROUP BY ALL), {i.PROC_NAMED}
SELECT host, name, round(cpu_a + 3e-8, 4) AS cpu_ms, round(rss_a + 3e-8, 4) AS rss, round(start_a, 0) AS start_time, n_a AS n FROM named""")
def proc_samples(spark, sf_dir):
    means = windows.window_means(
        i.proc_samples_in(spark, sf_dir), i.PROC_WINDOWS.a_start, i.PROC_WINDOWS.b_end
    )
    return rounded(proc.proc_samples(means), "cpu_ms", "rss").withColumn(
        "start_time", F.round("start_time", 0)
    )


@check("proc_diff", i.PROC + """SELECT host, name, metric, round(a + 3e-8, 4) AS a, round(b + 3e-8, 4) AS b, round(delta_pct + 3e-8, 4) AS delta_pct, verdict,
  restarted, round(start_a, 0) AS start_a, round(start_b, 0) AS start_b, unit,
  CASE verdict WHEN 'worse' THEN 0 WHEN 'appeared' THEN 1 WHEN 'gone' THEN 2 WHEN 'better' THEN 3 ELSE 4 END AS verdict_rank,
  round(CASE WHEN delta_pct IS NOT NULL THEN abs(delta_pct) WHEN a IS NULL OR b IS NULL THEN 1e300 ELSE 0 END + 3e-8, 4) AS weight FROM proc_rows""")
def proc_diff(spark, sf_dir):
    rows = proc_rows(spark, sf_dir).withColumns({
        "weight": F.least("weight", F.lit(1e300)),
        "start_a": F.round("start_a", 0), "start_b": F.round("start_b", 0),
    })
    return rounded(rows, "a", "b", "delta_pct", "weight")


@check("restarts", i.PROC + "SELECT host, name, round(start_a, 0) AS start_a, round(start_b, 0) AS start_b FROM proc_rows WHERE restarted AND metric = 'cpu'")
def restarts(spark, sf_dir):
    return proc.restarts(proc_rows(spark, sf_dir)).select(
        "host", "name", F.round("start_a", 0).alias("start_a"), F.round("start_b", 0).alias("start_b")
    )


@check("proc_report", i.PROC + """SELECT host, metric, verdict, count(*) AS n, count(*) FILTER (WHERE restarted) AS restarted,
  round(sum(delta_pct), 2) AS delta FROM proc_rows GROUP BY ALL""")
def proc_report(spark, sf_dir):
    report = reports.proc_report(i.proc_samples_in(spark, sf_dir), i.PROC_WINDOWS)
    return report.rows.groupBy("host", "metric", "verdict").agg(
        F.count("*").alias("n"), F.count_if("restarted").alias("restarted"),
        F.round(F.sum("delta_pct"), 2).alias("delta"),
    )


@check("hosts_without_data", i.PROC + "SELECT 'h' || c_custkey AS host FROM customer EXCEPT SELECT host FROM proc_rows")
def hosts_without_data(spark, sf_dir):
    hosts = i.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host")
    )
    return proc.hosts_without_data(proc_rows(spark, sf_dir), hosts)


# ---- state -----------------------------------------------------------------

MID = datetime(2024, 1, 16)
CHANGE = "section, title, key, kind, old, new, note, section_rank"


def half_facts(spark, sf_dir):
    """The facts before MID and from MID on, many snapshots of a host in either half."""
    facts = i.facts(spark, sf_dir)
    return facts.where(F.col("taken") < F.lit(str(MID)).cast("timestamp_ntz")), facts.where(
        F.col("taken") >= F.lit(str(MID)).cast("timestamp_ntz")
    )


def all_facts(spark, sf_dir):
    """One snapshot per host and side: the newest of either half."""
    return tuple(f.join(state.latest(f), ["host", "taken"], "left_semi") for f in half_facts(spark, sf_dir))


def _newest_of(half: str) -> str:
    return f"SELECT * FROM facts WHERE (host, taken) IN (SELECT (host, max(taken)) FROM facts WHERE {half} GROUP BY host)"


HALF_DIFF = f"WITH {i.FACTS}, " + i.state_diff_sql(_newest_of(f"taken < {i.sql_ts(MID)}"), _newest_of(f"taken >= {i.sql_ts(MID)}"))


@check("state_diff", HALF_DIFF + f" SELECT host, {CHANGE} FROM changes")
def state_diff(spark, sf_dir):
    return state.state_diff(*all_facts(spark, sf_dir))


@check("state_diff_skipped", HALF_DIFF + f" SELECT host, {CHANGE} FROM changes WHERE NOT (section = 'listen' AND host IN ('h1', 'h2'))")
def state_diff_skipped(spark, sf_dir):
    skipped = i.facts(spark, sf_dir).where((F.col("section") == "listen") & F.col("host").isin("h1", "h2"))
    return state.state_diff(*all_facts(spark, sf_dir), skipped=skipped)


@check("change_counts", HALF_DIFF + " SELECT host, section, title, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in state.CHANGE_KINDS) + " FROM changes GROUP BY ALL")
def change_counts(spark, sf_dir):
    return state.change_counts(state.state_diff(*all_facts(spark, sf_dir)))


@check("changed", HALF_DIFF + " SELECT DISTINCT f.host, f.host IN (SELECT host FROM changes) AS changed FROM facts f")
def changed(spark, sf_dir):
    changes = state.state_diff(*all_facts(spark, sf_dir))
    return state.changed(changes, i.facts(spark, sf_dir).select("host").distinct())


def per_hour_headers(spark, sf_dir):
    """Snapshot headers: one per user and hour in which the user had an event."""
    return i.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("taken"),
    ).distinct()


_HEADERS = "headers AS (SELECT DISTINCT 'u' || user_id AS host, date_trunc('hour', ts)::TIMESTAMP AS taken FROM events)"


@check("latest_snapshot", f"WITH {_HEADERS} SELECT host, max(taken) AS taken FROM headers GROUP BY host")
def latest_snapshot(spark, sf_dir):
    return state.latest(per_hour_headers(spark, sf_dir))


@check("snapshot_asof", f"WITH {_HEADERS} SELECT host, max(taken) AS taken FROM headers WHERE taken <= {i.sql_ts(MID)} GROUP BY host")
def snapshot_asof(spark, sf_dir):
    return state.snapshot_asof(per_hour_headers(spark, sf_dir), MID)


@check("snapshot_asof_nearest", f"WITH {_HEADERS} SELECT host, coalesce(max(taken) FILTER (WHERE taken <= TIMESTAMP '2024-01-04'), min(taken)) AS taken FROM headers GROUP BY host")
def snapshot_asof_nearest(spark, sf_dir):
    return state.snapshot_asof(per_hour_headers(spark, sf_dir), datetime(2024, 1, 4), strict=False)


def event_anchors(spark, sf_dir):
    return i.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.col("ts").alias("t")
    )


@check("snapshot_asof_join", f"""WITH {_HEADERS} SELECT e.event_id, h.host, e.ts AS t, h.taken
FROM events e ASOF JOIN headers h ON 'u' || e.user_id = h.host AND e.ts >= h.taken""")
def snapshot_asof_join(spark, sf_dir):
    return state.snapshot_asof_join(event_anchors(spark, sf_dir), per_hour_headers(spark, sf_dir))


@check("snapshot_asof_join_nearest", f"""WITH {_HEADERS}, firsts AS (SELECT host, min(taken) AS first FROM headers GROUP BY host)
SELECT e.event_id, f.host, e.ts AS t, coalesce(h.taken, f.first) AS taken FROM events e JOIN firsts f ON 'u' || e.user_id = f.host
ASOF LEFT JOIN headers h ON f.host = h.host AND e.ts >= h.taken""")
def snapshot_asof_join_nearest(spark, sf_dir):
    return state.snapshot_asof_join(
        event_anchors(spark, sf_dir), per_hour_headers(spark, sf_dir), strict=False
    )


@check("consecutive_pairs", f"WITH {_HEADERS} SELECT * FROM (SELECT host, lag(taken) OVER (PARTITION BY host ORDER BY taken) AS a_taken, taken AS b_taken FROM headers) WHERE a_taken IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return state.consecutive_pairs(per_hour_headers(spark, sf_dir))


@check("consecutive_diff", f"WITH {i.FACTS}, {i.CONSECUTIVE} SELECT host, a_taken, b_taken, {CHANGE} FROM changes")
def consecutive_diff(spark, sf_dir):
    return state.consecutive_diff(i.facts(spark, sf_dir))


CHOSEN = """headers AS (SELECT DISTINCT host, taken FROM facts), last AS (SELECT host, max(taken) AS b_taken FROM headers GROUP BY host),
pairs AS (SELECT h.host, coalesce(max(taken) FILTER (WHERE taken <= b_taken - INTERVAL 7 DAY), min(taken)) AS a_taken, b_taken
          FROM headers h JOIN last l ON h.host = l.host WHERE taken < b_taken GROUP BY h.host, b_taken), """ + i.state_diff_sql(
    "SELECT f.* FROM facts f JOIN pairs p ON f.host = p.host AND f.taken = p.a_taken",
    "SELECT f.* FROM facts f JOIN pairs p ON f.host = p.host AND f.taken = p.b_taken")


@check("fact_intervals", f"""WITH {i.FACTS}, numbers AS (
  SELECT host, taken, row_number() OVER (PARTITION BY host ORDER BY taken) AS n, lead(taken) OVER (PARTITION BY host ORDER BY taken) AS after
  FROM (SELECT DISTINCT host, taken FROM facts)),
last AS (SELECT host, taken, section, key, arg_max(value, seq) AS value, arg_max(note, seq) AS note FROM facts GROUP BY ALL),
numbered AS (SELECT l.*, n, after, n - row_number() OVER (PARTITION BY host, section, key, value ORDER BY taken) AS island FROM last l JOIN numbers USING (host, taken))
SELECT host, section, key, value, arg_min(note, taken) AS note, min(taken) AS since, max(taken) AS until, arg_max(coalesce(after, TIMESTAMP '9999-01-01'), taken) AS ended
FROM numbered GROUP BY host, section, key, value, island""")
def fact_intervals(spark, sf_dir):
    far = F.lit("9999-01-01").cast("timestamp_ntz")
    return state.fact_intervals(i.facts(spark, sf_dir)).withColumn("ended", F.coalesce("ended", far))


@check("state_report", f"WITH {i.FACTS}, {CHOSEN} SELECT p.a_taken, p.b_taken, c.* FROM changes c JOIN pairs p ON c.host = p.host")
def state_report(spark, sf_dir):
    return reports.state_report(i.facts(spark, sf_dir), since=timedelta(days=7)).changes


@check("summary_line", f"""WITH {i.FACTS}, {CHOSEN} SELECT host, '[2024-01-31] ' || count(*) || ' changes: +' ||
  count(*) FILTER (WHERE kind = 'added') || ' added ~' || count(*) FILTER (WHERE kind = 'modified') || ' modified -' ||
  count(*) FILTER (WHERE kind = 'removed') || ' removed' AS line FROM changes GROUP BY host
UNION ALL SELECT 'quiet', '[2024-01-31] no change'""")
def summary_line(spark, sf_dir):
    from opsdiff.plans.text_reports import summary_line as lines

    facts = i.facts(spark, sf_dir)
    report = reports.state_report(facts, since=timedelta(days=7))
    hosts = facts.select("host").distinct().unionByName(spark.range(1).select(F.lit("quiet").alias("host")))
    return lines(report, hosts, datetime(2024, 1, 31))


@check("snapshot_stats", f"""WITH {i.FACTS}, s AS (SELECT host, taken, section, count(*) AS n FROM facts GROUP BY ALL),
days AS (SELECT DISTINCT host, taken FROM facts), both_ AS (SELECT host, taken, section, n, NULL::VARCHAR AS skipped FROM s
  UNION ALL SELECT host, taken, 'modules', 0, 'not delivered' FROM days)
SELECT host, taken, section, sum(n)::BIGINT AS facts, max(skipped) AS skipped FROM both_ GROUP BY ALL""")
def snapshot_stats(spark, sf_dir):
    facts = i.facts(spark, sf_dir)
    return state.snapshot_stats(facts, _modules_skipped(facts))


def _modules_skipped(facts):
    return state.headers_of(facts).select(
        "host", "taken", F.lit("modules").alias("section"), F.lit("Kernel modules").alias("title"),
        F.lit("not delivered").alias("skipped"),
    )


@check("snapshot_totals", f"""WITH {i.FACTS}
SELECT host, taken, count(*) AS facts, count(DISTINCT section) + 1 AS sections, 1::BIGINT AS skipped FROM facts GROUP BY ALL""")
def snapshot_totals(spark, sf_dir):
    facts = i.facts(spark, sf_dir)
    return state.snapshot_totals(state.snapshot_stats(facts, _modules_skipped(facts)))


@check("newest_snapshots", f"WITH {_HEADERS} SELECT host, taken FROM headers ORDER BY taken DESC, host LIMIT 50")
def newest_snapshots(spark, sf_dir):
    return state.newest(per_hour_headers(spark, sf_dir), 50)


@check("retained", f"WITH {_HEADERS} SELECT host, taken FROM headers WHERE taken >= TIMESTAMP '2024-01-23 12:00:00'")
def retained(spark, sf_dir):
    return state.retained(per_hour_headers(spark, sf_dir), datetime(2024, 1, 30, 12))


@check("volatile_keys", f"""WITH k AS (SELECT o_orderkey, (['kernel.random.uuid', 'user.max.' || o_custkey, 'fs.quota', 'fs.quota.x',
  'net.ipv4.ip_forward', 'net.core.somaxconn', 'vm.p' || o_custkey])[o_orderkey % 7 + 1] AS key FROM orders)
SELECT o_orderkey, key, key IN ('kernel.random.uuid', 'fs.quota', 'net.ipv4.ip_forward') OR starts_with(key, 'user.') AS volatile FROM k""")
def volatile_keys(spark, sf_dir):
    customer = F.col("o_custkey").cast("string")
    keys = F.array(
        F.lit("kernel.random.uuid"), F.concat(F.lit("user.max."), customer), F.lit("fs.quota"),
        F.lit("fs.quota.x"), F.lit("net.ipv4.ip_forward"), F.lit("net.core.somaxconn"),
        F.concat(F.lit("vm.p"), customer),
    )
    orders = i.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", F.get(keys, (F.col("o_orderkey") % 7).cast("int")).alias("key")
    ).withColumn("volatile", state.is_volatile(F.col("key")))


# ---- trend -----------------------------------------------------------------

_BUCKET = f"time_bucket(INTERVAL 15 MINUTE, ts, {i.sql_ts(i.MONTH[0])})"


@check("trend", f"""WITH {i.SAMPLES}, {i.PRESETS} SELECT host, metric, instance, {_BUCKET} AS bucket, round(avg(value) + 3e-8, 4) AS value
FROM samples WHERE metric IN (SELECT metric FROM presets WHERE preset = 'cpu') GROUP BY ALL""")
def trend_points(spark, sf_dir):
    preset = builtin_catalog(spark).preset("cpu")
    return rounded(trend.trend(i.samples(spark, sf_dir), preset, *i.MONTH), "value")


@check("trend_last", f"""WITH {i.SAMPLES} SELECT host, metric, instance, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS bucket, arg_max(value, ts) AS value
FROM samples GROUP BY ALL""")
def trend_last(spark, sf_dir):
    samples = i.samples(spark, sf_dir)
    return trend.trend(samples, i.METRICS, *i.MONTH, step=DAY, how="last")


@check("trend_grid", f"""WITH {i.SAMPLES}, {i.PRESETS}, points AS (
  SELECT host, metric, instance, {_BUCKET} AS bucket, avg(value) AS value
  FROM samples WHERE metric IN (SELECT metric FROM presets WHERE preset = 'net') GROUP BY ALL),
grid AS (SELECT s.*, g.bucket FROM (SELECT DISTINCT host, metric, instance FROM points) s,
         generate_series({i.sql_ts(i.MONTH[0])}, TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE) g(bucket))
SELECT g.host, g.metric, g.instance, g.bucket, round(p.value + 3e-8, 4) AS value FROM grid g LEFT JOIN points p USING (host, metric, instance, bucket)""")
def trend_grid(spark, sf_dir):
    step = trend.trend_step(*i.MONTH)
    points = trend.trend(i.samples(spark, sf_dir), builtin_catalog(spark).preset("net"), *i.MONTH)
    return rounded(trend.fill_grid(points, *i.MONTH, step), "value")


@check("trend_overlay", f"""WITH {i.SAMPLES}, sided AS (
  SELECT host, metric, instance, ts AS moment, value, true AS today FROM samples WHERE ts >= TIMESTAMP '2024-01-02'
  UNION ALL SELECT host, metric, instance, ts + INTERVAL 1 DAY, value, false FROM samples WHERE ts < TIMESTAMP '2024-01-30')
SELECT host, metric, instance, time_bucket(INTERVAL 1 HOUR, moment, TIMESTAMP '2024-01-02') AS bucket,
  round(avg(value) FILTER (WHERE today) + 3e-8, 4) AS value, round(avg(value) FILTER (WHERE NOT today) + 3e-8, 4) AS earlier FROM sided GROUP BY ALL""")
def trend_overlay(spark, sf_dir):
    points = trend.overlay(
        i.samples(spark, sf_dir), i.METRICS, datetime(2024, 1, 2), datetime(2024, 1, 31),
        step=timedelta(hours=1),
    )
    return rounded(points, "value", "earlier")


@check("trend_wide", f"""WITH {i.SAMPLES} SELECT host, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS bucket,
  round(avg(value) FILTER (WHERE metric = 'kernel.all.load') + 3e-8, 4) AS "kernel.all.load",
  round(avg(value) FILTER (WHERE metric = 'network.interface.in.bytes' AND instance = 'i1') + 3e-8, 4) AS "network.interface.in.bytes-i1"
FROM samples WHERE metric IN ('kernel.all.load', 'network.interface.in.bytes') GROUP BY ALL""")
def trend_wide(spark, sf_dir):
    names = ["kernel.all.load", "network.interface.in.bytes"]
    points = rounded(trend.trend(i.samples(spark, sf_dir), names, *i.MONTH, step=DAY), "value")
    return trend.trend_wide(points, ["kernel.all.load", "network.interface.in.bytes-i1"])


@check("series_order", f"""WITH {i.SAMPLES}, points AS (
  SELECT host, metric, instance, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS bucket FROM samples GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY host ORDER BY metric, instance, bucket) AS n FROM points""")
def series_order(spark, sf_dir):
    points = trend.trend(i.samples(spark, sf_dir), i.METRICS, *i.MONTH, step=DAY).drop("value")
    return trend.numbered_points(points)


@check("report_order", i.DIFF + """SELECT host, metric, instance, kind, row_number() OVER (ORDER BY host, cat_idx, metric_idx, instance) AS n FROM rows_""")
def report_order(spark, sf_dir):
    rows = diff.window_diff(i.samples(spark, sf_dir), builtin_catalog(spark), i.HALVES)
    return diff.numbered_rows(rows).select("host", "metric", "instance", "kind", "n")


@check("trend_series", f"""WITH {i.SAMPLES}, points AS (
  SELECT host, CASE WHEN instance = '' THEN metric ELSE metric || '-' || instance END AS series,
         epoch_ms(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01')) AS ms, avg(value) AS v FROM samples GROUP BY ALL)
SELECT host, series, count(*) AS n, string_agg(ms::VARCHAR, ' ' ORDER BY ms) AS times, round(sum(v) + 3e-8, 4) AS total FROM points GROUP BY ALL""")
def trend_series(spark, sf_dir):
    series = trend.as_series(trend.trend(i.samples(spark, sf_dir), i.METRICS, *i.MONTH, step=DAY))
    return series.select(
        "host", "series", F.size("points").cast("bigint").alias("n"),
        F.array_join(F.transform("points", lambda p: p["ms"].cast("string")), " ").alias("times"),
        near(F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["v"])).alias("total"),
    )


@check("trend_step", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  least(greatest(round(l_quantity * l_linenumber * 120 / 600.0), 10), 900)::BIGINT AS step FROM lineitem""")
def trend_step(spark, sf_dir):
    start = F.col("l_shipdate")
    end = start + F.make_dt_interval(secs=F.col("l_quantity") * F.col("l_linenumber") * 120)
    return i.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        trend.trend_step_seconds(start, end).alias("step"),
    )


@check("window_presets", """WITH e AS (SELECT event_id, ts, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('day', ts)::TIMESTAMP AS d FROM events)
SELECT event_id, 'yesterday' AS preset, h - INTERVAL 25 HOUR AS a_start, h - INTERVAL 24 HOUR AS a_end, h - INTERVAL 1 HOUR AS b_start, h AS b_end FROM e
UNION ALL SELECT event_id, 'previous_hour', h - INTERVAL 2 HOUR, h - INTERVAL 1 HOUR, h - INTERVAL 1 HOUR, h FROM e
UNION ALL SELECT event_id, 'today', d - INTERVAL 1 DAY, d, d, ts FROM e""")
def window_presets(spark, sf_dir):
    events = i.table(spark, sf_dir, "events")
    parts = [
        events.select("event_id", F.lit(p).alias("preset"), *windows.window_columns(p, F.col("ts")))
        for p in windows.DIFF_PRESETS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("bad_windows", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_quantity <= 0 OR l_linenumber % 3 = 0 THEN 'window a: end not after start' WHEN l_quantity > 32 THEN 'window a: longer than 32 days'
       WHEN l_discount * 200000 > 10000 THEN 'threshold outside 0..10000' END AS problem
FROM lineitem WHERE l_linenumber % 3 = 0 OR l_quantity > 32 OR l_discount * 200000 > 10000""")
def bad_windows(spark, sf_dir):
    start = F.col("l_shipdate")
    days = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_quantity").cast("int"))
    per_host = i.table(spark, sf_dir, "lineitem").withColumns({
        "a_start": start, "a_end": start + F.make_dt_interval(days=days),
        "b_start": start, "b_end": start + F.make_dt_interval(days=F.lit(1)),
        "threshold_pct": F.col("l_discount") * 200000,
    })
    return windows.bad_windows(per_host).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "problem"
    )
