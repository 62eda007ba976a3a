"""Checks of captured text, summary text, stored snapshots and text reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsdiff.checks import inputs as i
from opsdiff.checks import tables
from opsdiff.checks.base import check, near
from opsdiff.operators import facts as etl
from opsdiff.plans import reports, text_reports
from opsdiff.session import shared_dir
from opsdiff.sources import report_json, snapshots, summary_text, trend_csv

# ---- captured host text ----------------------------------------------------
# Captures are composed from the given tables: documents become files and page
# addresses, orders and parts become the lines of command outputs.

_FILES = [
    "/etc/crontab", "/etc/cron.d/d", "/etc/ssh/sshd_config", "/etc/pam.d/d", "/etc/sudoers",
    "/home/u/.ssh/authorized_keys", "/etc/hosts", "/etc/fstab", "/etc/unknown/d",
]


def file_captures(spark, sf_dir):
    doc = F.col("doc_id")
    names = F.array(*[F.lit(f) for f in _FILES])
    return i.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")).alias("host"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("taken"),
        F.get(names, (doc % len(_FILES)).cast("int")).alias("path"),
        F.col("text").alias("content"),
    )


@check("file_facts", f"""WITH x AS (SELECT 'd' || doc_id AS host, doc_id % {len(_FILES)} AS k, ({i.sql_list(_FILES)})[doc_id % {len(_FILES)} + 1] AS path,
  sha256(text)[1:24] AS value FROM documents)
SELECT host, CASE WHEN k < 2 THEN 'cron' WHEN k < 4 THEN 'configs' WHEN k < 6 THEN 'security' WHEN k = 6 THEN 'network' ELSE 'storage' END AS section,
  CASE k WHEN 4 THEN 'sudoers.hash' WHEN 5 THEN 'authorized_keys:' || path WHEN 6 THEN 'hosts.hash' WHEN 7 THEN 'fstab.hash' ELSE path END AS key, value
FROM x WHERE k < 8""")
def file_facts(spark, sf_dir):
    return etl.parse_facts(file_captures(spark, sf_dir)).select("host", "section", "key", "value")


# Command or file whose lines are made of an order: k (key), c (customer), s (status).
_LISTINGS = [
    ("ip route show", "10.{k}.0.0/16 via {c}"),
    ("ip -o addr show", "{k}: eth{c} inet 10.0.{k}.1/24 scope {s}"),
    ("/etc/resolv.conf", "nameserver 10.{k}.{c}.1"),
    ("ss", 'tcp LISTEN 0 {c} 0.0.0.0:{k} *:* users:(("app{c}",pid=1,fd=3))'),
    ("/proc/mounts", "/dev/sd{c} /mnt/{k} ext4 rw,{s} 0 0"),
    ("/proc/mdstat", "md{k} : active raid{c} {s}"),
    ("lsblk", "`-sd{k} {c}G part"),
    ("systemctl list-units", "app{k}.service loaded active {s} text {c}"),
    ("systemctl list-unit-files", "app{k}.service enabled {c}"),
    ("rpm", "pkg{k} 1.{c}-{s}"),
    ("/proc/modules", "mod{k} {c} 0 - Live"),
    ("/etc/os-release", 'PRETTY_NAME="Linux {k}.{c}"'),
    ("/proc/cpuinfo", "model name : Cpu {k} {s}"),
    ("/proc/meminfo", "MemTotal: {k} kB"),
    ("/proc/sys/vm/p{k}", "{c}\t{s}"),
    ("/proc/sys/kernel/kptr_restrict", " {c} "),
    ("getenforce", "Enforcing{c}"),
    ("nft list ruleset", "table {k} {c}"),
    ("/proc/unknown", "{k} {c}"),
]
_EXPECTED = [
    ("network", "route:10.{k}.0.0/16", "10.{k}.0.0/16 via {c}"),
    ("network", "addr:eth{c}:10.0.{k}.1/24", "inet 10.0.{k}.1/24"),
    ("network", "resolv:nameserver 10.{k}.{c}.1", "nameserver 10.{k}.{c}.1"),
    ("listen", "tcp 0.0.0.0:{k}", "app{c}"),
    ("storage", "mount:/mnt/{k}", "/dev/sd{c} ext4 rw,{s}"),
    ("storage", "mdraid:md{k}", "md{k} : active raid{c} {s}"),
    ("storage", "blk:sd{k}", "{c}G part"),
    ("services", "app{k}.service", "active/{s}"),
    ("services", "enabled:app{k}.service", "enabled"),
    ("packages", "pkg{k}", "1.{c}-{s}"),
    ("modules", "mod{k}", "loaded"),
    ("system", "os", "Linux {k}.{c}"),
    ("system", "cpu.model", "Cpu {k} {s}"),
    ("system", "mem.total", "{k} kB"),
    ("sysctl", "vm.p{k}", "{c} {s}"),
    ("security", "kernel.kptr_restrict", "{c}"),
    ("security", "selinux", "Enforcing{c}"),
    None,  # hash, spelled out below
    None,
]


def _filled(form):
    out = form
    for mark, column in [("{k}", "o_orderkey"), ("{c}", "o_custkey"), ("{s}", "o_orderstatus")]:
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def listing_captures(spark, sf_dir):
    """One capture per order: a blank line, the line, an unrelated short line."""
    way = (F.col("o_orderkey") % len(_LISTINGS)).cast("int")
    forms = F.get(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(x).alias("line")) for p, x in _LISTINGS]), way)
    single = F.col("path").startswith("/proc/sys/") | F.col("path").startswith("nft") | (F.col("path") == "getenforce")
    return i.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("host"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("taken"),
        _filled(forms["path"]).alias("path"), _filled(forms["line"]).alias("line"),
    ).withColumn(
        "content", F.when(single, F.col("line")).otherwise(F.concat(F.lit("\n  "), "line", F.lit(" \n\n")))
    )


def _sql_filled(form: str) -> str:
    text = i.sql_text(form)
    for mark, column in [("{k}", "o_orderkey"), ("{c}", "o_custkey"), ("{s}", "o_orderstatus")]:
        text = text.replace(mark, f"' || {column} || '")
    return f"({text})"


_LISTING_SQL = " UNION ALL ".join(
    f"SELECT 'o' || o_orderkey AS host, '{e[0]}' AS section, {_sql_filled(e[1])} AS key, {_sql_filled(e[2])} AS value "
    f"FROM orders WHERE o_orderkey % {len(_LISTINGS)} = {n}"
    for n, e in enumerate(_EXPECTED) if e
) + (
    f" UNION ALL SELECT 'o' || o_orderkey, 'firewall', 'nftables.ruleset.hash', sha256('table ' || o_orderkey || ' ' || o_custkey)[1:24] "
    f"FROM orders WHERE o_orderkey % {len(_LISTINGS)} = {len(_LISTINGS) - 2}"
)


@check("listing_facts", _LISTING_SQL)
def listing_facts(spark, sf_dir):
    return etl.parse_facts(listing_captures(spark, sf_dir)).select("host", "section", "key", "value")


@check("skipped_sections", f"""WITH got AS ({_LISTING_SQL}), sections(section, reason) AS (VALUES {', '.join(f"('{n}', '{r or ''}')" for n, _, r in i.STATE_SECTIONS)})
SELECT 'o' || o.o_orderkey AS host, s.section, CASE WHEN g.section IS NOT NULL THEN '' ELSE s.reason END AS skipped
FROM orders o CROSS JOIN sections s LEFT JOIN got g ON g.host = 'o' || o.o_orderkey AND g.section = s.section""")
def skipped_sections(spark, sf_dir):
    captures = listing_captures(spark, sf_dir)
    return etl.parse_sections(captures, etl.parse_facts(captures)).select("host", "section", "skipped")


@check("fallback_captures", """SELECT 'o' || o_custkey AS host, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'rpm' ELSE 'dpkg-query' END AS source
FROM orders GROUP BY o_custkey""")
def fallback_captures(spark, sf_dir):
    # Every customer ships a dpkg listing, those with a finished order an rpm one too.
    orders = i.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("has_rpm"))
    both = F.when(F.col("has_rpm"), F.array(F.lit("rpm"), F.lit("dpkg-query"))).otherwise(F.array(F.lit("dpkg-query")))
    captures = orders.select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("host"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("taken"), F.explode(both).alias("path"),
    ).withColumn("content", F.concat(F.lit("a "), "path"))
    return etl.parse_facts(captures).select("host", F.col("value").alias("source"))


@check("first_listener", """SELECT 'u' || user_id AS host, 'tcp :' || (event_id % 3) AS key, arg_min(event_type, event_id) AS value
FROM events GROUP BY ALL""")
def first_listener(spark, sf_dir):
    # One capture per user; its lines are the user's events in order.
    line = F.concat(
        F.lit("tcp LISTEN 0 0 :"), (F.col("event_id") % 3).cast("string"), F.lit(' * users:(("'),
        "event_type", F.lit('",pid=1))'),
    )
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda e: e["l"]
    )
    captures = i.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_join(lines, "\n").alias("content")
    ).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("taken"), F.lit("ss").alias("path"), "content",
    )
    return etl.parse_facts(captures).select("host", "key", "value")


# ---- summary text ----------------------------------------------------------


@check("summary_text", """SELECT event_id, 'app.' || event_type AS metric, CASE WHEN event_id % 2 = 0 THEN 'u ' || user_id ELSE '' END AS instance,
  round(value + 3e-8, 4) AS val, CASE WHEN event_id % 3 = 0 THEN 'millisec / second' ELSE 'none' END AS units
FROM events WHERE event_id % 7 < 5""")
def summary_text_lines(spark, sf_dir):
    n = F.col("event_id")
    instance = F.when(n % 2 == 0, F.concat(F.lit(' ["u '), F.col("user_id").cast("string"), F.lit('"]'))).otherwise("")
    line = F.concat(
        F.lit("app."), "event_type", instance, F.lit("  "), F.col("value").cast("string"), F.lit(" "),
        F.when(n % 3 == 0, "millisec / second").otherwise("none"),
    )
    lines = i.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 7 < 5, line).when(n % 7 == 5, F.concat(F.lit(" "), line))
        .otherwise("Performance metrics from host").alias("value"),
    )
    return summary_text.parse_summary(lines).withColumn("val", near("val"))


# ---- stored snapshots ------------------------------------------------------


@check("stored_facts", f"WITH {i.FACTS} SELECT host, taken, section, key, value, note, seq FROM facts")
def stored_facts(spark, sf_dir):
    path = shared_dir(spark, "facts")
    snapshots.write_snapshot(i.facts(spark, sf_dir), path)
    return snapshots.read_facts(spark, path).select(
        "host", "taken", "section", "key", "value", "note", "seq"
    )


def _store(spark, sf_dir):
    """Two committed batches, the second one delivered again, and one whose writer stopped half way."""
    path, facts = shared_dir(spark, "store"), i.facts(spark, sf_dir)
    early = F.col("taken") < F.lit("2024-01-16").cast("timestamp_ntz")
    snapshots.write_flat_snapshots(facts.where(early), path, "first")
    snapshots.write_flat_snapshots(facts.where(~early), path, "second")
    snapshots.write_flat_snapshots(facts, path, "second")
    stray = facts.withColumns({"key": F.lit("stray"), "date": F.to_date("taken"), "batch": F.lit("stray")})
    stray.write.mode("append").partitionBy("date", "batch").parquet(f"{path}/facts")
    return path


@check("stored_state_report", f"WITH {i.FACTS}, {tables.CHOSEN} SELECT p.a_taken, p.b_taken, c.* FROM changes c JOIN pairs p ON c.host = p.host")
def stored_state_report(spark, sf_dir):
    return reports.stored_state_report(spark, _store(spark, sf_dir), since=timedelta(days=7)).changes


@check("stored_history", f"WITH {i.FACTS}, {i.CONSECUTIVE} SELECT host, a_taken, b_taken, {tables.CHANGE} FROM changes")
def stored_history(spark, sf_dir):
    return reports.stored_history(spark, _store(spark, sf_dir))


@check("snapshot_bodies", f"WITH {i.FACTS} SELECT host, section, key, count(*) AS n, max(value) AS value FROM facts GROUP BY ALL")
def snapshot_bodies(spark, sf_dir):
    # One body per fact is enough to read the nested form; bodies are made here, not stored.
    item = F.struct("key", "value", "note")
    section = F.struct(F.col("section").alias("name"), "title", F.array(item).alias("items"))
    bodies = i.facts(spark, sf_dir).select(
        F.to_json(F.struct("host", F.col("taken").cast("timestamp").alias("taken"), F.array(section).alias("sections"))).alias("value")
    )
    facts = snapshots.explode_snapshot(snapshots.parse_snapshots(bodies))
    return facts.groupBy("host", "section", "key").agg(F.count("*").alias("n"), F.max("value").alias("value"))


@check("markers", f"""WITH {i.FACTS}, sides AS (SELECT '7' AS name, * FROM ({tables._newest_of(f"taken < {i.sql_ts(tables.MID)}")})
UNION ALL SELECT '007' AS name, * FROM ({tables._newest_of(f"taken >= {i.sql_ts(tables.MID)}")}))
SELECT name, host, taken, section, key, value, note, seq FROM sides""")
def markers(spark, sf_dir):
    # Two names that look like one number, and one whose baseline is replaced by an empty one.
    before, after = tables.half_facts(spark, sf_dir)
    path = shared_dir(spark, "markers")
    for name, facts in (("7", after), ("007", after), ("7", before), ("gone", before), ("gone", before.where("false"))):
        snapshots.save_marker(name, facts, path)
    loaded = [snapshots.load_marker(spark, n, path).withColumn("name", F.lit(n)) for n in ("7", "007", "gone")]
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2]).select(
        "name", "host", "taken", "section", "key", "value", "note", "seq"
    )


@check("trend_csv", """WITH cells AS (SELECT user_id, event_id, ts, unnest([
    {s: CASE WHEN event_id % 2 = 0 THEN 'a.value' ELSE 'b.value' END, v: value::DOUBLE}, {s: 'a.user', v: user_id::DOUBLE}], recursive := true) FROM events)
SELECT 'h' || (user_id % 8) AS host, s AS series, ts::TIMESTAMP AS bucket, round(v + 3e-8, 4) AS value FROM cells""")
def trend_csv_files(spark, sf_dir):
    # Files of every host with one of two headers, whose columns differ in name and order.
    path = shared_dir(spark, "csv")
    events = i.table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id") % 8).alias("host"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time"),
        "event_id", "value", "user_id",
    )
    even, odd = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    for part, columns in (
        (even, [F.col("value").alias("a.value"), F.col("user_id").alias("a.user")]),
        (odd, [F.col("user_id").alias("a.user"), F.col("value").alias("b.value")]),
    ):
        part.select("host", "Time", *columns).write.mode("append").partitionBy("host").option("header", True).csv(path)
    return trend_csv.read_trend_csv(spark, path, host_pattern="host=([^/]+)/").withColumn("value", near("value"))


@check("verify_report", tables.HALF_DIFF + f" SELECT host, {tables.CHANGE} FROM changes")
def verify_report(spark, sf_dir):
    # Baseline and facts are histories of many days; the baseline is replaced once.
    before, after = tables.half_facts(spark, sf_dir)
    path = shared_dir(spark, "markers")
    reports.verify_start(after, path, "release")
    reports.verify_start(before, path, "release")
    reports.verify_start(after, path, "other")
    return reports.verify_report(spark, "release", after, path).changes.select(
        "host", "section", "title", "key", "kind", "old", "new", "note", "section_rank"
    )


# ---- text reports ----------------------------------------------------------


def _week(spark, sf_dir):
    keep = shared_dir(spark, "changes")
    return reports.state_report(i.facts(spark, sf_dir), since=timedelta(days=7), keep=keep)


@check("state_lines", f"""WITH {i.FACTS}, {tables.CHOSEN} SELECT host, CASE kind WHEN 'added' THEN '  + ' || key || ' = ' || new || '  ' || note
  WHEN 'removed' THEN '  - ' || key || '  (was ' || old || ')' ELSE '  ~ ' || key || ': ' || old || ' → ' || new END AS line FROM changes
UNION ALL SELECT host, '== ' || title || ' ==  (' || count(*) || ')' FROM changes GROUP BY host, section, title
UNION ALL SELECT host, '' FROM changes GROUP BY host, section, title
UNION ALL SELECT host, unnest(['state report', '  A ' || strftime(a_taken, '%Y-%m-%d %H:%M:%S'), '  B ' || strftime(b_taken, '%Y-%m-%d %H:%M:%S'), '', '']) FROM pairs
UNION ALL SELECT host, '▲ ' || count(*) || ' changes' FROM changes GROUP BY host""")
def state_lines(spark, sf_dir):
    return text_reports.state_lines(_week(spark, sf_dir)).select("host", "line")


@check("state_lines_numbered", f"""WITH {i.FACTS}, {tables.CHOSEN}, l AS (
SELECT host, 2 AS part, section_rank AS major, section AS block, 0 AS minor, key AS text, 0 AS sub,
  CASE kind WHEN 'added' THEN '  + ' || key || ' = ' || new || '  ' || note
  WHEN 'removed' THEN '  - ' || key || '  (was ' || old || ')' ELSE '  ~ ' || key || ': ' || old || ' → ' || new END AS line FROM changes
UNION ALL SELECT host, 2, section_rank, section, -1, '', 0, '== ' || title || ' ==  (' || count(*) || ')' FROM changes GROUP BY host, section, title, section_rank
UNION ALL SELECT host, 2, section_rank, section, 1, '', 0, '' FROM changes GROUP BY host, section, section_rank
UNION ALL SELECT host, 0, 0, '', 0, '', unnest([0, 1, 2, 3]), unnest(['state report', '  A ' || strftime(a_taken, '%Y-%m-%d %H:%M:%S'),
  '  B ' || strftime(b_taken, '%Y-%m-%d %H:%M:%S'), '']) FROM pairs
UNION ALL SELECT host, 1, 0, '', 0, '', 0, '▲ ' || count(*) || ' changes' FROM changes GROUP BY host
UNION ALL SELECT host, 1, 0, '', 0, '', 1, '' FROM pairs)
SELECT host, row_number() OVER (PARTITION BY host ORDER BY part, major, block, minor, text, sub) AS line_no, line FROM l""")
def state_lines_numbered(spark, sf_dir):
    return text_reports.numbered_lines(text_reports.state_lines(_week(spark, sf_dir)))


@check("markdown_lines", f"""WITH {i.FACTS}, {tables.CHOSEN}, c AS (SELECT * REPLACE (
    translate(CASE WHEN strlen(old) > 60 THEN left(old, 57) || '...' ELSE old END, '|`', '  ') AS old,
    translate(CASE WHEN strlen(new) > 60 THEN left(new, 57) || '...' ELSE new END, '|`', '  ') AS new) FROM changes)
SELECT host, CASE kind WHEN 'added' THEN '| 🟢 | `' || key || '` | added = `' || new || '` |'
  WHEN 'removed' THEN '| ⚪ | `' || key || '` | removed (was `' || old || '`) |' ELSE '| 🟡 | `' || key || '` | `' || old || '` → `' || new || '` |' END AS line FROM c
UNION ALL SELECT host, unnest(['### ' || title || ' (' || count(*) || ')', '', '| | Item | Change |', '|---|---|---|', '']) FROM c GROUP BY host, section, title
UNION ALL SELECT host, unnest(['## Change impact', '', '- Baseline A: `' || strftime(a_taken, '%Y-%m-%d %H:%M:%S') || '`',
  '- Compare B: `' || strftime(b_taken, '%Y-%m-%d %H:%M:%S') || '`', '', '']) FROM pairs
UNION ALL SELECT host, '⚠️ **' || count(*) || ' changes** - 🟢 ' || count(*) FILTER (WHERE kind = 'added') || ' added · 🟡 ' ||
  count(*) FILTER (WHERE kind = 'modified') || ' modified · ⚪ ' || count(*) FILTER (WHERE kind = 'removed') || ' removed' FROM c GROUP BY host""")
def markdown_lines(spark, sf_dir):
    return text_reports.markdown_lines(_week(spark, sf_dir)).select("host", "line")


def written(spark, report, make, name):
    """The lines of a report, through the sorted text sink and back."""
    path = shared_dir(spark, name)
    with report:
        text_reports.write_lines(make(report), path)
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias("host"), parts[1].alias("line"))


@check("diff_lines")
def diff_lines(spark, sf_dir):
    # No SQL: shown digits of means may differ in the last place between engines.
    report = reports.compare(i.samples(spark, sf_dir), i.HALVES)
    return written(spark, report, text_reports.diff_lines, "diff-lines")


@check("proc_lines")
def proc_lines(spark, sf_dir):
    report = reports.proc_report(i.proc_samples_in(spark, sf_dir), i.PROC_WINDOWS)
    now = i.PROC_WINDOWS.b_end
    return written(spark, report, lambda r: text_reports.proc_lines(r, now), "proc-lines")


@check("report_json", i.DIFF + """SELECT 'rows' AS part, host, metric, instance, verdict, a IS NULL AS no_a FROM rows_""")
def report_json_rows(spark, sf_dir):
    lines = report_json.json_rows(tables.diff_rows(spark, sf_dir), "rows")
    parsed = F.from_json("json", "host STRING, metric STRING, instance STRING, verdict STRING, a DOUBLE")
    return lines.select("part", parsed.alias("r")).select(
        "part", "r.host", "r.metric", "r.instance", "r.verdict", F.col("r.a").isNull().alias("no_a")
    )
