"""Stored snapshots, named baselines and retention.

Facts and sections are stored flat, one row each, in parquet partitioned by
day: an as-of query reads the narrow header columns, a difference the days it
needs.  Snapshot bodies in JSON can be read as well.

What belongs together becomes visible together: the tables of a batch are written to folders of their
own, and one small commit record, written last, names them.  Readers go by the records, so that
a batch whose writer died half way is not there, and can be written again.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.session import delete_path, fetched_if_small

FACT_COLUMNS = ["host", "taken", "section", "title", "key", "value", "note", "seq"]

SNAPSHOT_JSON = (
    "host STRING, taken TIMESTAMP, sections ARRAY<STRUCT<name: STRING, title: STRING, "
    "items: ARRAY<STRUCT<key: STRING, value: STRING, note: STRING>>, skipped: STRING>>"
)


def write_snapshot(facts: DataFrame, path: str) -> None:
    """Appends the facts of one or many snapshots; times are cut to the second."""
    (
        facts.withColumn("taken", F.date_trunc("second", "taken").cast(facts.schema["taken"].dataType))
        .withColumn("date", F.to_date("taken"))
        .write.mode("append").partitionBy("date").parquet(path)
    )


# ---- commit records --------------------------------------------------------

COMMIT = "batch string, folder string, at long"


def _commit(spark: SparkSession, path: str, batch: str, folder: str) -> None:
    """One record in one file: it is there or it is not."""
    record = spark.createDataFrame([(batch, folder, time.time_ns())], COMMIT)
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """The commit records below a path, None if nothing was ever committed there."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _children(spark: SparkSession, path: str) -> list:
    """Folders below a path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []


TABLES = ("headers", "sections", "facts")


def write_batch(tables: dict[str, DataFrame], path: str, batch: str | None = None) -> str:
    """Appends headers, sections and facts as one batch and returns its name.

    A batch of a name that is committed already is not written again, so that a repeated
    micro-batch or a job that is run again adds nothing.
    """
    path, batch = path.rstrip("/"), batch or uuid.uuid4().hex
    spark = tables["headers"].sparkSession
    known = _commits(spark, path)
    if known is not None and known.where(F.col("batch") == batch).limit(1).count():
        return batch
    folder = uuid.uuid4().hex  # of this attempt alone
    for name in TABLES:
        rows = tables[name].withColumns({"date": F.to_date("taken"), "batch": F.lit(folder)})
        rows.write.mode("append").partitionBy("date", "batch").parquet(f"{path}/{name}")
    _commit(spark, path, batch, folder)
    return batch


def _to_second(df: DataFrame) -> DataFrame:
    return df.withColumn("taken", F.date_trunc("second", "taken").cast(df.schema["taken"].dataType))


def write_snapshots(snapshots: DataFrame, path: str, batch: str | None = None) -> str:
    """Appends whole snapshots (host, taken, sections) as three tables below ``path``; see write_batch.

    headers has one row per snapshot, so that one without facts is there as well; sections has
    titles and the reasons why sections were skipped; facts has one row per fact.
    """
    cut = _to_second(snapshots)
    return write_batch({
        "headers": cut.select("host", "taken").distinct(),
        "sections": explode_sections(cut),
        "facts": explode_snapshot(cut),
    }, path, batch)


def write_flat_snapshots(facts: DataFrame, path: str, batch: str | None = None) -> str:
    """As write_snapshots, from facts (FACT_COLUMNS): headers and sections are those that have facts."""
    cut = _to_second(facts).select(*FACT_COLUMNS)
    sections = cut.groupBy("host", "taken", "section").agg(F.max("title").alias("title"))
    return write_batch({
        "headers": cut.select("host", "taken").distinct(),
        "sections": sections.withColumn("skipped", F.lit("")),
        "facts": cut,
    }, path, batch)


def read_snapshot_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """headers, sections or facts of all committed batches; ValueError when there is none."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name!r}")
    path = path.rstrip("/")
    commits = _commits(spark, path)
    if commits is None:
        raise ValueError(f"no snapshots are stored in {path!r}")
    # Of a batch that two writers committed at the same time the first record counts.
    first = commits.groupBy("batch").agg(F.min_by("folder", "at").alias("folder"))
    kept = fetched_if_small(first.select(F.col("folder").alias("batch")))
    return spark.read.parquet(f"{path}/{name}").join(kept, "batch", "left_semi").drop("batch")


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Deletes the folders of batches that were never committed; to be run while nobody writes."""
    path, commits = path.rstrip("/"), _commits(spark, path.rstrip("/"))
    known = set() if commits is None else {r["folder"] for r in commits.select("folder").toLocalIterator()}
    stray = [
        folder for name in TABLES for day in _children(spark, f"{path}/{name}") for folder in _children(spark, day.toString())
        if folder.getName().removeprefix("batch=") not in known
    ]
    for folder in stray:
        delete_path(spark, folder.toString())
    return len(stray)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_snapshots(bodies: DataFrame, body: str = "value") -> DataFrame:
    """(host, taken, sections) from JSON bodies; see rejected_bodies for those that are no snapshot."""
    parsed = bodies.select(F.from_json(body, SNAPSHOT_JSON).alias("s")).select("s.*")
    return parsed.where(F.col("taken").isNotNull()).withColumn(
        "taken", F.date_trunc("second", "taken")
    )


def rejected_bodies(bodies: DataFrame, body: str = "value") -> DataFrame:
    """The rows whose body is no snapshot, all columns: with parse_snapshots every body is in one table."""
    return bodies.where(F.from_json(body, SNAPSHOT_JSON)["taken"].isNull())


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots from files with one JSON body per line."""
    return parse_snapshots(spark.read.text(path, lineSep="\n"))


def explode_snapshot(snapshots: DataFrame) -> DataFrame:
    """One row per fact; ``seq`` is the position in the section, the last of a key counts."""
    return snapshots.select("host", "taken", F.inline("sections")).select(
        "host", "taken", F.col("name").alias("section"), "title",
        F.posexplode("items").alias("seq", "item"),
    ).select(
        "host", "taken", "section", "title", "item.key",
        F.coalesce("item.value", F.lit("")).alias("value"),
        F.coalesce("item.note", F.lit("")).alias("note"), "seq",
    )


def explode_sections(snapshots: DataFrame) -> DataFrame:
    """One row per section, also for sections without facts."""
    return snapshots.select("host", "taken", F.inline("sections")).select(
        "host", "taken", F.col("name").alias("section"), "title",
        F.coalesce("skipped", F.lit("")).alias("skipped"),
    )


# ---- named baselines -------------------------------------------------------


def _marker_path(name: str, path: str) -> str:
    # A folder of its own for each name, spelled so that no two names share one.
    return f"{path.rstrip('/')}/{quote(name, safe='')}.marker"


def save_marker(name: str, facts: DataFrame, path: str) -> None:
    """Stores facts as the baseline ``name``, replacing an earlier one of that name, also by none.

    The facts go to a new version; a record written last makes it the current one.  Until then, and
    if the writer fails, readers find the version before, which stays until the next is there.
    """
    spark, root = facts.sparkSession, _marker_path(name, path)
    version = uuid.uuid4().hex
    facts.write.parquet(f"{root}/versions/{version}")
    _commit(spark, root, name, version)
    old = {r["folder"] for r in _versions(spark, root)[2:]}  # not what another writer is about to commit
    for folder in _children(spark, f"{root}/versions"):
        if folder.getName() in old:
            delete_path(spark, folder.toString())


def _versions(spark: SparkSession, root: str) -> list:
    """The committed versions of a baseline, the current one first."""
    commits = _commits(spark, root)
    return [] if commits is None else commits.orderBy(F.desc("at"), "folder").collect()


def latest_marker(facts: DataFrame) -> DataFrame:
    """Of every host the facts of the newest baseline only."""
    newest = facts.groupBy("host").agg(F.max("taken").alias("taken"))
    return facts.join(newest, ["host", "taken"], "left_semi")


def load_marker(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Facts of the baseline ``name``, none if it was saved empty; ValueError when there is none."""
    versions = _versions(spark, _marker_path(name, path))
    if not versions:
        raise ValueError(f"no baseline named {name!r}")
    return latest_marker(spark.read.parquet(f"{_marker_path(name, path)}/versions/{versions[0]['folder']}"))


# ---- retention -------------------------------------------------------------


def drop_expired_days(spark: SparkSession, path: str, now: datetime, keep_days: int = 7) -> list[str]:
    """Deletes the day folders that lie wholly before the retention period.

    The rest of the cut-off day stays on disk until the day has passed;
    ``retained`` hides it from readers, so results are exact at any time.
    Returns the names of the folders that were deleted.
    """
    cutoff = (now - timedelta(days=keep_days)).date().isoformat()
    expired = [
        folder for folder in _children(spark, path)
        if folder.getName().startswith("date=") and folder.getName()[len("date="):] < cutoff
    ]
    for folder in expired:
        delete_path(spark, folder.toString())
    return sorted(folder.getName() for folder in expired)
