"""The given tables seen as samples, facts, process samples and captured text.

Every table comes twice: as a DataFrame and as a SQL common table expression,
both over the whole of the given table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.operators.proc import PROC_METRICS
from opsdiff.operators.windows import Windows
from opsdiff.sources.catalog import builtin_rows
from opsdiff.sources.fixed_values import DIAGNOSIS_RULES, STATE_SECTIONS, TREND_PRESETS

UNLISTED = ["site.requests", "site.errors", "site.queue.depth"]
METRICS = [r["metric"] for r in builtin_rows()] + UNLISTED
INSTANCED = r"percpu|\.dev\.|\.dm\.|\.md\.|interface|filesys"

MONTH = (datetime(2024, 1, 1), datetime(2024, 1, 31))
# The two halves of the month: together they cover every event.
HALVES = Windows(
    datetime(2024, 1, 1), datetime(2024, 1, 16), datetime(2024, 1, 16), datetime(2024, 1, 31)
)
PROC_WINDOWS = Windows(
    datetime(1995, 1, 1), datetime(1998, 7, 1), datetime(1998, 7, 1), datetime(2002, 1, 1), 20.0
)
SECTION_OF = {
    "click": "network", "error": "listen", "purchase": "packages", "signup": "sysctl",
    "view": "site",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_ts(t: datetime) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


# ---- samples ---------------------------------------------------------------


def samples_of(events: DataFrame) -> DataFrame:
    ordinal = F.col("event_id") % len(METRICS)
    names = F.array(*[F.lit(m) for m in METRICS])
    return (
        events.withColumn("metric", F.get(names, ordinal.cast("int")))
        .select(
            F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"),
            "ts", "metric",
            F.when(F.col("metric").rlike(INSTANCED), F.concat(F.lit("i"), F.col("user_id") % 6))
            .otherwise("").alias("instance"),
            "value",
            F.when(ordinal % 3 == 0, "KB").otherwise("count / second").alias("units"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "events"))


SAMPLES = f"""samples AS (
  SELECT 'h' || (user_id % 8) AS host, ts, metric,
         CASE WHEN regexp_matches(metric, '{INSTANCED}') THEN 'i' || (user_id % 6) ELSE '' END AS instance,
         value, CASE WHEN ordinal % 3 = 0 THEN 'KB' ELSE 'count / second' END AS units
  FROM (SELECT *, event_id % {len(METRICS)} AS ordinal,
               ({sql_list(METRICS)})[event_id % {len(METRICS)} + 1] AS metric FROM events))"""

CATALOG = "catalog(metric, label, category, polarity, fold, own_threshold, min_abs, cat_idx, metric_idx, core) AS (VALUES " + ", ".join(
    f"({sql_text(r['metric'])}, {sql_text(r['label'])}, {sql_text(r['category'])}, {sql_text(r['polarity'])}, "
    f"{r['fold']}, {r['threshold_pct']}::DOUBLE, {r['min_abs']}::DOUBLE, {r['cat_idx']}, {r['metric_idx']}, {r['core']})"
    for r in builtin_rows()
) + ")"

RULES = "rules(rule_idx, id, severity, n_conds, cond_idx, metric, verdict, delta_gte, delta_lte, b_gte, b_gt_zero, appeared) AS (VALUES " + ", ".join(
    "({}, {}, {}, {}, {}, {}, {}, {}, {}, {}, {}, {})".format(
        i, sql_text(r["id"]), sql_text(r["severity"]), len(r["when"]), j, sql_text(c["metric"]),
        sql_text(c.get("verdict", "")),
        *[f"{c[k]}::DOUBLE" if k in c else "NULL::DOUBLE" for k in ["delta_gte", "delta_lte", "b_gte"]],
        c.get("b_gt_zero", False), c.get("appeared", False),
    )
    for i, r in enumerate(DIAGNOSIS_RULES) for j, c in enumerate(r["when"])
) + ")"


def means_sql(w: Windows, source: str = "samples", name: str = "means") -> str:
    in_a = f"ts >= {sql_ts(w.a_start)} AND ts < {sql_ts(w.a_end)}"
    in_b = f"ts >= {sql_ts(w.b_start)} AND ts < {sql_ts(w.b_end)}"
    return f"""{name} AS (
  SELECT coalesce(x.host, y.host) AS host, coalesce(x.metric, y.metric) AS metric,
         coalesce(x.instance, y.instance) AS instance, coalesce(y.units, x.units) AS units,
         x.val AS a, y.val AS b
  FROM (SELECT host, metric, instance, max(units) AS units, avg(value) AS val FROM {source} WHERE {in_a} GROUP BY ALL) x
  FULL OUTER JOIN
       (SELECT host, metric, instance, max(units) AS units, avg(value) AS val FROM {source} WHERE {in_b} GROUP BY ALL) y
  ON x.host = y.host AND x.metric = y.metric AND x.instance = y.instance)"""


def judge_sql(thr: str, floor: str = "min_abs", pol: str = "polarity") -> str:
    """delta_pct, exceeded and verdict of columns a and b, written as a decision table."""
    quiet = f"({floor} > 0 AND abs(a) < {floor} AND abs(b) < {floor})"
    d = "((b - a) / abs(a) * 100)"

    def way(up: str) -> str:
        return (
            f"CASE WHEN {pol} = 'worse_up' THEN CASE WHEN {up} THEN 'worse' ELSE 'better' END "
            f"WHEN {pol} = 'better_up' THEN CASE WHEN {up} THEN 'better' ELSE 'worse' END ELSE 'watch' END"
        )

    return f"""
  CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN NULL ELSE {d} END AS delta_pct,
  CASE WHEN a IS NULL OR b IS NULL THEN true WHEN {quiet} THEN false WHEN a = 0 THEN b <> 0
       ELSE abs({d}) >= {thr} END AS exceeded,
  CASE WHEN a IS NULL OR b IS NULL THEN 'watch' WHEN {quiet} THEN 'flat'
       WHEN a = 0 AND b = 0 THEN 'flat' WHEN a = 0 THEN {way('b > 0')}
       WHEN abs({d}) < {thr} THEN 'flat' ELSE {way(d + ' > 0')} END AS verdict"""


ROWS = f"""rows_ AS (
  SELECT *, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' ELSE verdict END AS kind
  FROM (SELECT m.*, c.* EXCLUDE (metric),
        {judge_sql("(CASE WHEN own_threshold > 0 THEN own_threshold ELSE 15 END)")}
        FROM means m JOIN catalog c ON m.metric = c.metric))"""

DIFF = "WITH " + ", ".join([SAMPLES, CATALOG, means_sql(HALVES), ROWS]) + " "
DIFF_RULES = "WITH " + ", ".join([SAMPLES, CATALOG, RULES, means_sql(HALVES), ROWS])

# ---- processes -------------------------------------------------------------


def proc_samples_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.col("l_linenumber") % 4
    command = F.concat(
        F.col("l_suppkey").cast("string"), F.lit(" /usr/bin/"),
        F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_size").cast("string"),
    )
    return joined.select(
        F.concat(F.lit("h"), F.col("l_suppkey") % 16).alias("host"),
        F.get(F.array(*[F.lit(m) for m in PROC_METRICS]), kind).alias("metric"),
        command.alias("instance"),
        F.col("l_shipdate").alias("ts"),
        F.when(kind == 3, F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("double"))
        .when(kind == 2, F.col("l_extendedprice")).otherwise(F.col("l_quantity")).alias("value"),
    )


PROC_SAMPLES = f"""proc AS (
  SELECT 'h' || (l_suppkey % 16) AS host, ({sql_list(PROC_METRICS)})[l_linenumber % 4 + 1] AS metric,
         l_suppkey || ' /usr/bin/' || replace(p_name, ' ', '-') || '-' || p_size AS instance, '' AS units,
         l_shipdate AS ts,
         CASE l_linenumber % 4 WHEN 3 THEN epoch_ms(l_shipdate)::DOUBLE WHEN 2 THEN l_extendedprice
              ELSE l_quantity END AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PROC_NAMED = f"""named AS (
  SELECT host, regexp_replace(split_part(instance, ' ', 2), '^.*/', '') AS name,
         count(a) AS n_a, count(b) AS n_b,
         coalesce(sum(CASE WHEN metric IN ({sql_text(PROC_METRICS[0])}, {sql_text(PROC_METRICS[1])}) THEN a END), 0) AS cpu_a,
         coalesce(sum(CASE WHEN metric IN ({sql_text(PROC_METRICS[0])}, {sql_text(PROC_METRICS[1])}) THEN b END), 0) AS cpu_b,
         coalesce(max(CASE WHEN metric = {sql_text(PROC_METRICS[2])} THEN a END), 0) AS rss_a,
         coalesce(max(CASE WHEN metric = {sql_text(PROC_METRICS[2])} THEN b END), 0) AS rss_b,
         coalesce(max(CASE WHEN metric = {sql_text(PROC_METRICS[3])} THEN a END), 0) AS start_a,
         coalesce(max(CASE WHEN metric = {sql_text(PROC_METRICS[3])} THEN b END), 0) AS start_b
  FROM means GROUP BY ALL)"""

PROC_ROWS = f"""pairs AS (
  SELECT host, name, 'cpu' AS metric, CASE WHEN n_a > 0 THEN cpu_a END AS a, CASE WHEN n_b > 0 THEN cpu_b END AS b,
         n_a, n_b, start_a, start_b, 'ms/s' AS unit FROM named
  UNION ALL
  SELECT host, name, 'mem', CASE WHEN n_a > 0 THEN rss_a END, CASE WHEN n_b > 0 THEN rss_b END,
         n_a, n_b, start_a, start_b, 'KB' FROM named),
proc_rows AS (
  SELECT *, n_a > 0 AND n_b > 0 AND start_a > 0 AND start_b - start_a > 60000 AS restarted,
    CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN NULL
         ELSE (b - a) / abs(a) * 100 END AS delta_pct,
    CASE WHEN a IS NULL THEN 'appeared' WHEN b IS NULL THEN 'gone' WHEN a = 0 AND b = 0 THEN 'flat'
         WHEN a = 0 THEN 'worse' WHEN abs((b - a) / abs(a) * 100) < 20 THEN 'flat'
         WHEN b > a THEN 'worse' ELSE 'better' END AS verdict
  FROM pairs)"""

PROC = "WITH " + ", ".join([PROC_SAMPLES, means_sql(PROC_WINDOWS, "proc"), PROC_NAMED, PROC_ROWS]) + " "

# ---- facts -----------------------------------------------------------------


def facts_of(events: DataFrame) -> DataFrame:
    """One snapshot per host and day; of several events of a user the last one stands."""
    section = F.col("event_type")
    named = F.lit(None).cast("string")
    for kind, name in SECTION_OF.items():
        named = F.when(section == kind, name).otherwise(named)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return events.select(
        F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"),
        day.alias("taken"),
        named.alias("section"),
        F.concat(named, F.lit(" "), F.dayofmonth("ts") % 3).alias("title"),
        F.concat(F.lit("k"), F.col("user_id")).alias("key"),
        F.col("props").alias("value"),
        F.concat(F.lit("n"), F.col("event_id") % 5).alias("note"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "events"))


FACTS = f"""facts AS (
  SELECT 'h' || (user_id % 8) AS host, date_trunc('day', ts)::TIMESTAMP AS taken, section,
         section || ' ' || (day(ts) % 3) AS title, 'k' || user_id AS key, props AS value,
         'n' || (event_id % 5) AS note, epoch_us(ts) AS seq
  FROM (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION_OF.items())} END AS section FROM events))"""

SECTION_RANK = "CASE section " + " ".join(
    f"WHEN '{name}' THEN {i}" for i, (name, _, _) in enumerate(STATE_SECTIONS)
) + f" ELSE {len(STATE_SECTIONS)} END"


def state_diff_sql(side_a: str, side_b: str, group: str = "host") -> str:
    """Full outer join of two sides (each with group, section, title, key, value, note, seq)."""
    keys = [g.strip() for g in group.split(",")]
    using = ", ".join([*keys, "section", "key"])
    last = f"SELECT {group}, section, key, arg_max(value, seq) AS value, arg_max(note, seq) AS note FROM ({{}}) GROUP BY ALL"
    title = f"SELECT {group}, section, max(title) AS title FROM ({{}}) GROUP BY ALL"
    on_t = ", ".join([*keys, "section"])
    return f"""changes AS (
  SELECT {", ".join("d." + k for k in keys)}, d.section, coalesce(tb.title, ta.title) AS title, d.key, d.kind, d.old, d.new, d.note,
         {SECTION_RANK.replace("CASE section", "CASE d.section")} AS section_rank
  FROM (SELECT {using}, a.value AS old, b.value AS new,
               CASE WHEN b.value IS NOT NULL THEN b.note ELSE a.note END AS note,
               CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'modified' END AS kind
        FROM ({last.format(side_a)}) a FULL OUTER JOIN ({last.format(side_b)}) b USING ({using})
        WHERE a.value IS DISTINCT FROM b.value) d
  LEFT JOIN ({title.format(side_a)}) ta USING ({on_t})
  LEFT JOIN ({title.format(side_b)}) tb USING ({on_t}))"""


CONSECUTIVE = f"""headers AS (SELECT DISTINCT host, taken FROM facts),
pairs AS (SELECT * FROM (SELECT host, lag(taken) OVER (PARTITION BY host ORDER BY taken) AS a_taken, taken AS b_taken FROM headers)
          WHERE a_taken IS NOT NULL),
{state_diff_sql(
    "SELECT p.a_taken, p.b_taken, f.* EXCLUDE (taken) FROM facts f JOIN pairs p ON f.host = p.host AND f.taken = p.a_taken",
    "SELECT p.a_taken, p.b_taken, f.* EXCLUDE (taken) FROM facts f JOIN pairs p ON f.host = p.host AND f.taken = p.b_taken",
    "host, a_taken, b_taken")}"""

PRESETS = "presets(preset, metric) AS (VALUES " + ", ".join(
    f"({sql_text(key)}, {sql_text(m)})" for key, _, metrics in TREND_PRESETS for m in metrics
) + ")"
