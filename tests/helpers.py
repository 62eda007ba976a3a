from datetime import datetime

from opsdiff.operators.windows import Windows

A0, A1 = datetime(2024, 3, 1, 10), datetime(2024, 3, 1, 11)
B0, B1 = datetime(2024, 3, 1, 12), datetime(2024, 3, 1, 13)
WINDOWS = Windows(A0, A1, B0, B1)
SAMPLE = "host string, ts timestamp_ntz, metric string, instance string, value double, units string"


def at(text: str) -> datetime:
    return datetime.fromisoformat(f"2024-03-01 {text}")


def samples(spark, rows):
    """rows: (host, 'HH:MM[:SS]', metric, instance, value)"""
    return spark.createDataFrame([(h, at(t), m, n, v, "u") for h, t, m, n, v in rows], SAMPLE)


def two_sided(spark, rows):
    """rows: (host, metric, instance, a, b); NULL means no sample on that side."""
    out = []
    for host, metric, instance, a, b in rows:
        if a is not None:
            out.append((host, "10:30", metric, instance, float(a)))
        if b is not None:
            out.append((host, "12:30", metric, instance, float(b)))
    return samples(spark, out)


def dicts(df, *columns):
    return [r.asDict(True) for r in (df.select(*columns) if columns else df).collect()]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def exchanges(df, *columns):
    """How many shuffles of the plan move all of these columns."""
    conf, count = df.sparkSession.conf, 0
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # else shuffles are planned as the query runs
    try:
        todo = [df.select("*")._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                out = {node.output().apply(i).name() for i in range(node.output().size())}
                count += set(columns) <= out
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
    return count


def scans(df):
    """How many times files were read, where shuffles that are alike run once."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return final.count("FileScan")
