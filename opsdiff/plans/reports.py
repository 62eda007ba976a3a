"""The four reports, each a set of lazily evaluated tables."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.operators.chunks import DAY
from opsdiff.operators.dedupe import missing_catalog_metrics, union_warnings
from opsdiff.operators.diff import regressed, verdict_counts, window_diff
from opsdiff.operators.proc import hosts_without_data, proc_diff, restarts
from opsdiff.operators.rules import findings, software_block
from opsdiff.operators.state import (
    change_counts, choose_pair, consecutive_diff, diff_pairs, headers_of, latest, state_diff,
)
from opsdiff.operators.triage import triage
from opsdiff.operators.windows import Windows
from opsdiff.sources.catalog import Catalog, builtin_catalog
from opsdiff.sources.report_json import write_json
from opsdiff.sources.rules import Rules, builtin_rules
from opsdiff.sources.snapshots import load_marker, read_snapshot_table, save_marker


def stored(df: DataFrame, path: str | None) -> DataFrame:
    """The table written to ``path`` and read back, so that its readers share one computation."""
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Report:
    """Tables of a report by name; the base table can be kept while several are read."""

    base = "rows"

    def parts(self) -> dict[str, DataFrame]:
        return {
            f.name: getattr(self, f.name) for f in fields(self)
            if isinstance(getattr(self, f.name), DataFrame)
        }

    def to_json(self, path: str) -> None:
        with self:
            write_json(self.parts(), path)

    def __enter__(self):
        getattr(self, self.base).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *exc) -> None:
        getattr(self, self.base).unpersist()


@dataclass
class DiffReport(Report):
    rows: DataFrame
    findings: DataFrame
    triage: DataFrame
    counts: DataFrame
    missing: DataFrame
    regressed: DataFrame
    warnings: DataFrame | None
    windows: Windows | DataFrame


def compare(
    samples: DataFrame, windows: Windows | DataFrame, catalog: Catalog | None = None,
    rules: Rules | None = None, hosts: DataFrame | None = None, keep: str | None = None,
    warnings: list[DataFrame] | None = None,
) -> DiffReport:
    """Regression report: rows, findings, board of five blocks, counts, metrics not recorded.

    All tables are made from the rows.  ``keep`` names a folder on shared storage
    where the rows are written first; without it, use the report as a context
    (``with compare(...) as report``) to keep them on the executors.  ``hosts`` lists hosts that have to show up on the
    board even when they recorded nothing.  ``warnings`` are those of reading window A and of
    reading window B (host, seq, warning); the report has each text once per host.
    """
    spark = samples.sparkSession
    catalog = catalog or builtin_catalog(spark)
    rules = rules or builtin_rules(spark)
    rows = stored(window_diff(samples, catalog, windows), keep)
    found = findings(rows, rules)
    board = triage(rows, hosts)
    everyone = rows.select("host").distinct() if hosts is None else hosts
    return DiffReport(
        rows=rows,
        findings=found,
        triage=board.unionByName(software_block(found, everyone)),
        counts=verdict_counts(rows),
        missing=missing_catalog_metrics(rows, catalog, hosts),
        regressed=regressed(rows, found),
        warnings=union_warnings(*warnings) if warnings else None,
        windows=windows,
    )


@dataclass
class ProcReport(Report):
    rows: DataFrame
    restarts: DataFrame
    no_data: DataFrame | None
    warnings: DataFrame | None
    windows: Windows | DataFrame

    def cpu(self) -> DataFrame:
        return self.rows.where(F.col("metric") == "cpu")

    def mem(self) -> DataFrame:
        return self.rows.where(F.col("metric") == "mem")


def proc_report(
    samples: DataFrame, windows: Windows | DataFrame, hosts: DataFrame | None = None,
    keep: str | None = None, warnings: list[DataFrame] | None = None,
) -> ProcReport:
    """Process report: processor and memory rows, restarts, hosts that have no process data, warnings."""
    rows = stored(proc_diff(samples, windows), keep)
    return ProcReport(
        rows=rows,
        restarts=restarts(rows),
        no_data=None if hosts is None else hosts_without_data(rows, hosts),
        warnings=union_warnings(*warnings) if warnings else None,
        windows=windows,
    )


@dataclass
class StateReport(Report):
    changes: DataFrame
    counts: DataFrame
    totals: DataFrame
    pairs: DataFrame
    base = "changes"


def _state_report(changes: DataFrame, pairs: DataFrame) -> StateReport:
    return StateReport(
        changes=changes,
        counts=change_counts(changes),
        totals=change_counts(changes, by_section=False),
        pairs=pairs,
    )


def state_report(
    facts: DataFrame, a: datetime | None = None, b: datetime | None = None,
    since: timedelta = DAY, headers: DataFrame | None = None, keep: str | None = None,
) -> StateReport:
    """Change report of every host between two of its snapshots (see choose_pair)."""
    pairs = choose_pair(headers_of(facts) if headers is None else headers, a, b, since)
    return _state_report(stored(diff_pairs(facts, pairs), keep), pairs)


def stored_state_report(
    spark: SparkSession, path: str, a: datetime | None = None, b: datetime | None = None,
    since: timedelta = DAY, keep: str | None = None,
) -> StateReport:
    """state_report over stored snapshots: the pairs come from the headers alone, so that a
    snapshot without facts counts, and of the facts the days of the pairs are read."""
    headers = read_snapshot_table(spark, path, "headers")
    return state_report(read_snapshot_table(spark, path, "facts"), a, b, since, headers, keep)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """consecutive_diff over stored snapshots, with their headers and the titles of their sections."""
    headers, sections, facts = (read_snapshot_table(spark, path, n) for n in ("headers", "sections", "facts"))
    return consecutive_diff(facts, headers, sections)


def verify_start(facts: DataFrame, path: str, name: str | None = None, now: datetime | None = None) -> str:
    """Stores the current facts as a named baseline and returns the name."""
    name = name or f"release-{now or datetime.now():%Y%m%d-%H%M%S}"
    save_marker(name, facts, path)
    return name


def verify_report(spark: SparkSession, name: str, after: DataFrame, path: str) -> StateReport:
    """What changed since the named baseline; of a history the newest snapshot of each host counts."""
    before = load_marker(spark, name, path)
    newest = latest(after)
    pairs = latest(before).withColumnRenamed("taken", "a_taken").join(
        newest.withColumnRenamed("taken", "b_taken"), "host"
    )
    return _state_report(state_diff(before, after.join(newest, ["host", "taken"], "left_semi")), pairs)
