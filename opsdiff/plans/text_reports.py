"""Reports as text: every line is a row, sorted by (host, *LINE_ORDER) when written.

Lines carry a sort key, so no host has to pass through one task; ``write_lines`` range-sorts them at
the end, ``numbered_lines`` numbers them by ranges.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.functions.judge import PROC_KINDS
from opsdiff.functions.text import delta_text, fixed, fmt_val, md_escape
from opsdiff.operators.diff import focus
from opsdiff.operators.ordinals import with_ordinal
from opsdiff.operators.proc import restart_text
from opsdiff.operators.windows import Windows
from opsdiff.plans.reports import DiffReport, ProcReport, StateReport
from opsdiff.session import broadcast_if_small

# part, major, block: which block of the report; minor, text: which entry of the
# block; sub: which line of the entry.
LINE_ORDER = ["part", "major", "block", "minor", "text", "sub"]


def _line(
    part: int | Column, line: str | Column, major=0, block="", minor=0, text="", sub=0,
    when: Column | None = None,
) -> Column:
    """One line with its place in the report; NULL where ``when`` does not hold."""

    def col(x, kind: str) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    made = F.struct(
        col(part, "int").alias("part"), col(major, "double").alias("major"),
        col(block, "string").alias("block"), col(minor, "double").alias("minor"),
        col(text, "string").alias("text"), col(sub, "int").alias("sub"),
        col(line, "string").alias("line"),
    )
    return made if when is None else F.when(when, made)


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    """All lines that one table gives, in one pass over it."""
    return df.select("host", F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes (host, line) in order: files in name order give the reports host by host."""
    ordered = lines.orderBy("host", *LINE_ORDER)
    ordered.select(F.concat_ws("\t", "host", "line").alias("value")).write.mode("overwrite").text(path)


def numbered_lines(lines: DataFrame, path: str | None = None) -> DataFrame:
    """(host, line_no, line) of a report's lines; the sorted lines are written below ``path`` on the way."""
    return with_ordinal(lines, [*LINE_ORDER, "line"], "line_no", within="host", path=path).select("host", "line_no", "line")


def _aligned(
    rows: DataFrame, keys: list[str], cells: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``line``, the cells in columns as wide as their widest cell and two
    blanks between, and the table of blocks.

    Widths are one aggregate per block, joined back.
    """
    named = rows.withColumns({f"_c{i}": c for i, c in enumerate(cells)})
    last = len(cells) - 1
    widths = named.groupBy(*keys).agg(
        *[F.max(F.length(f"_c{i}")).alias(f"_w{i}") for i in range(last)]
    )
    padded = [F.rpad(F.col(f"_c{i}"), F.col(f"_w{i}") + 2, F.lit(" ")) for i in range(last)]
    lines = named.join(widths, keys).withColumn("line", F.concat(*padded, F.col(f"_c{last}")))
    return lines, widths


def _with_windows(hosts: DataFrame, windows: Windows | DataFrame) -> DataFrame:
    """Hosts with a_start, a_end, b_start, b_end and threshold_pct: the same for all, or each host's own."""
    names = ["a_start", "a_end", "b_start", "b_end", "threshold_pct"]
    if isinstance(windows, DataFrame):
        return hosts.join(broadcast_if_small(windows.select("host", *names)), "host", "left")
    times = {n: F.lit(getattr(windows, n).isoformat(sep=" ")).cast("timestamp_ntz") for n in names[:4]}
    return hosts.withColumns(times | {"threshold_pct": F.lit(float(windows.threshold_pct))})


def _span(side: str, between: str) -> Column:
    start = F.date_format(f"{side}_start", "MM-dd HH:mm")
    return F.concat(start, F.lit(between), F.date_format(f"{side}_end", "HH:mm"))


def _threshold() -> Column:
    return F.concat(fixed(F.col("threshold_pct"), 0), F.lit("%"))


# ---- regression report -----------------------------------------------------

_MARKS = {"worse": "x", "better": "+", "watch": "!", "new": "+", "gone": "-", "flat": "."}


def _map(column: Column, values: dict[str, str], default: str) -> Column:
    expr = F.lit(default)
    for key, value in values.items():
        expr = F.when(column == key, value).otherwise(expr)
    return expr


def diff_lines(report: DiffReport, show_all: bool = False) -> DataFrame:
    """Findings, counts, then the rows of every category; windows may be each host's own."""
    found = report.findings
    rule = F.col("rule_idx")
    tag = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("conclusion"))
    has_next = F.coalesce(F.size("next"), F.lit(0)) > 0

    def tail(column: str, name: str) -> Column:
        n = F.col(column)
        return F.when(n > 0, F.concat(F.lit(f" · {name} "), n.cast("string"))).otherwise("")

    counts = F.concat(
        F.lit("worse "), "n_worse", F.lit(" · better "), "n_better", F.lit(" · watch "), "n_watch",
        F.lit(" · flat "), "n_flat", tail("n_new", "appeared"), tail("n_gone", "gone"),
    )
    window = F.concat(
        F.lit("[A "), _span("a", " -> "), F.lit("] vs [B "), _span("b", " -> "), F.lit("] · threshold "), _threshold()
    )
    diagnosed = found.select("host").distinct().withColumn("diagnosed", F.lit(True))
    shown = report.rows if show_all else focus(report.rows)
    kind = F.col("kind")
    name = F.when(
        F.col("instance") != "", F.concat("label", F.lit(" ["), "instance", F.lit("]"))
    ).otherwise(F.col("label"))
    cells = [
        F.concat(_map(kind, _MARKS, "."), F.lit(" "), name),
        fmt_val(F.col("a")), fmt_val(F.col("b")),
        delta_text(kind, F.col("delta_pct")),
        F.when(kind == "new", "appeared").otherwise(kind),
        F.coalesce("units", F.lit("")),
    ]
    body, blocks = _aligned(shown, ["host", "category", "cat_idx"], cells)
    category = F.col("cat_idx")
    return _union([
        _lines(
            _with_windows(report.counts.join(diagnosed, "host", "left"), report.windows),
            _line(0, "[diagnosis] no known pattern matched, the rows follow.",
                  when=F.col("diagnosed").isNull()),
            _line(1, counts), _line(1, window, sub=1), _line(1, "", sub=2),
        ),
        _lines(
            found,
            _line(0, tag, major=rule),
            _line(0, F.concat(F.lit("  evidence: "), F.array_join("evidence", " · ")), major=rule, sub=1),
            _line(0, F.concat(F.lit("  next: "), F.array_join("next", "  |  ")), major=rule, sub=2,
                  when=has_next),
            _line(0, "", major=rule, sub=3),
        ),
        _lines(blocks, _line(2, F.concat(F.lit("—— "), "category", F.lit(" ——")), major=category, minor=-1)),
        _lines(body, _line(2, F.col("line"), major=category, minor=F.col("metric_idx"), text=F.col("instance"))),
    ])


# ---- process report --------------------------------------------------------


def proc_lines(report: ProcReport, now: datetime) -> DataFrame:
    """Restarts, then processor and memory rows that changed; ages are relative to ``now``."""
    rows = report.rows.withColumn("measure", F.when(F.col("metric") == "cpu", 2).otherwise(3))
    measure = F.col("measure")
    ages = restart_text(F.col("start_a"), F.col("start_b"), F.lit(now.timestamp() * 1000.0))
    title = F.when(measure == 2, "== Processor time (more is worse) ==").otherwise("== Memory ==")
    # One block of rows per measure, in the order cpu, mem.
    blocks = rows.groupBy("host", "measure").agg(
        F.count_if(F.col("verdict") != "flat").alias("shown"),
        F.count_if("restarted").alias("restarts"),
    )
    once, restarted = measure == 2, (measure == 2) & (F.col("restarts") > 0)
    body, _ = _aligned(
        focus(rows, "verdict"), ["host", "measure"],
        [
            F.concat(F.lit("  "), "name", F.when(F.col("restarted"), " ⟳").otherwise("")),
            fmt_val(F.col("a")), fmt_val(F.col("b")),
            delta_text(F.col("verdict"), F.col("delta_pct")), F.col("verdict"), F.col("unit"),
        ],
    )
    return _union([
        _lines(
            _with_windows(blocks, report.windows),
            _line(0, "process report", when=once),
            _line(0, F.concat(F.lit("  A "), _span("a", " ~ ")), sub=1, when=once),
            _line(0, F.concat(F.lit("  B "), _span("b", " ~ "), F.lit("  (threshold "), _threshold(), F.lit(")")), sub=2, when=once),
            _line(0, "", sub=3, when=once),
            _line(1, "⟳ restarted between the windows", major=0, when=restarted),
            _line(1, "", major=2, when=restarted),
            _line(measure, F.concat(title, F.lit("  ("), "shown", F.lit(" changed)")), major=-1),
            _line(measure, "  nothing changed much", when=F.col("shown") == 0),
            _line(measure, "", major=len(PROC_KINDS) + 1),
        ),
        _lines(
            report.restarts,
            _line(1, F.concat(F.lit("  "), "name", F.lit("  "), ages), major=1, text=F.col("name")),
        ),
        _lines(
            body,
            _line(measure, F.col("line"), major=F.col("verdict_rank"), minor=-F.col("weight"),
                  text=F.col("name")),
        ),
    ])


# ---- state report ----------------------------------------------------------


def summary_line(report: StateReport, hosts: DataFrame, day: datetime) -> DataFrame:
    """One line per host for logs: the number of changes by kind, or ``no change``."""
    n = F.coalesce(F.col("total"), F.lit(0))
    text = F.when(n == 0, f"[{day:%Y-%m-%d}] no change").otherwise(F.concat(
        F.lit(f"[{day:%Y-%m-%d}] "), n.cast("string"), F.lit(" changes: +"),
        F.col("added").cast("string"), F.lit(" added ~"), F.col("modified").cast("string"),
        F.lit(" modified -"), F.col("removed").cast("string"), F.lit(" removed"),
    ))
    return hosts.select("host").join(report.totals, "host", "left").select("host", text.alias("line"))


def _moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _state_keys(report: StateReport) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with totals, sections and changes, all keyed by host."""
    pairs = report.pairs.join(
        report.totals.drop("a_taken", "b_taken"), "host", "left"
    ).withColumn("n", F.coalesce(F.col("total"), F.lit(0)))
    changes = report.changes
    sections = changes.groupBy("host", "section", "title", "section_rank").agg(F.count("*").alias("n"))
    return pairs, sections, changes


def state_lines(report: StateReport) -> DataFrame:
    """Plain text: the two moments, the number of changes, one line per change."""
    pairs, sections, changes = _state_keys(report)
    kind, key = F.col("kind"), F.col("key")
    change = (
        F.when(kind == "added", F.concat(
            F.lit("  + "), key, F.lit(" = "), "new",
            F.when(F.col("note") != "", F.concat(F.lit("  "), "note")).otherwise(""),
        ))
        .when(kind == "removed", F.concat(F.lit("  - "), key, F.lit("  (was "), "old", F.lit(")")))
        .otherwise(F.concat(F.lit("  ~ "), key, F.lit(": "), "old", F.lit(" → "), "new"))
    )
    rank, block, n = F.col("section_rank"), F.col("section"), F.col("n")
    count = n.cast("string")
    return _union([
        _lines(
            pairs,
            _line(0, "state report"),
            _line(0, F.concat(F.lit("  A "), _moment("a_taken")), sub=1),
            _line(0, F.concat(F.lit("  B "), _moment("b_taken")), sub=2),
            _line(0, "", sub=3),
            _line(1, "Both moments are identical, nothing changed.", when=n == 0),
            _line(1, F.concat(F.lit("▲ "), count, F.lit(" changes")), when=n > 0),
            _line(1, "", sub=1, when=n > 0),
        ),
        _lines(
            sections,
            _line(2, F.concat(F.lit("== "), "title", F.lit(" ==  ("), count, F.lit(")")),
                  major=rank, block=block, minor=-1),
            _line(2, "", major=rank, block=block, minor=1),
        ),
        _lines(changes, _line(2, change, major=rank, block=block, text=key)),
    ])


def markdown_lines(report: StateReport, title: str = "Change impact") -> DataFrame:
    """Markdown: header, counts, one table per section."""
    pairs, sections, changes = _state_keys(report)
    kind = F.col("kind")

    def code(column: Column) -> Column:
        return F.concat(F.lit("`"), column, F.lit("`"))

    old, new = md_escape(F.col("old")), md_escape(F.col("new"))
    cell = (
        F.when(kind == "added", F.concat(F.lit("added = "), code(new)))
        .when(kind == "removed", F.concat(F.lit("removed (was "), code(old), F.lit(")")))
        .otherwise(F.concat(code(old), F.lit(" → "), code(new)))
    )
    mark = F.when(kind == "added", "🟢").when(kind == "removed", "⚪").otherwise("🟡")
    row = F.concat(F.lit("| "), mark, F.lit(" | "), code(F.col("key")), F.lit(" | "), cell, F.lit(" |"))
    total = F.concat(
        F.lit("⚠️ **"), F.col("n").cast("string"), F.lit(" changes** - 🟢 "), "added",
        F.lit(" added · 🟡 "), "modified", F.lit(" modified · ⚪ "), "removed", F.lit(" removed"),
    )
    rank, block, n = F.col("section_rank"), F.col("section"), F.col("n")

    def table(text: str | Column, sub: int, minor: int = -1) -> Column:
        return _line(2, text, major=rank, block=block, minor=minor, sub=sub)

    return _union([
        _lines(
            pairs,
            _line(0, f"## {title}"), _line(0, "", sub=1),
            _line(0, F.concat(F.lit("- Baseline A: "), code(_moment("a_taken"))), sub=2),
            _line(0, F.concat(F.lit("- Compare B: "), code(_moment("b_taken"))), sub=3),
            _line(0, "", sub=4),
            _line(1, "✅ **Nothing changed** - both moments are identical.", when=n == 0),
            _line(1, total, when=n > 0), _line(1, "", sub=1, when=n > 0),
        ),
        _lines(
            sections,
            table(F.concat(F.lit("### "), "title", F.lit(" ("), n.cast("string"), F.lit(")")), 0),
            table("", 1), table("| | Item | Change |", 2), table("|---|---|---|", 3),
            table("", 0, minor=1),
        ),
        _lines(changes, _line(2, row, major=rank, block=block, text=F.col("key"))),
    ])
