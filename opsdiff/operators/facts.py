"""Facts out of captured host text.

A capture is what an agent shipped: ``captures(host, taken, path, content)``,
one row per file or command output, ``path`` being the file path or the command
words.  Parsing is one narrow pass: every capture becomes an array of facts in
one expression and is exploded, so nothing is shuffled but the few captures
that another one of the same snapshot can replace (fallback commands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.functions.text import clean_lines, first_quoted, hash12, strip, word, words
from opsdiff.operators.state import is_volatile
from opsdiff.sources.fixed_values import (
    CONFIG_FILES, CRON_FILES, KEY_FILES, SECURITY_SYSCTL, STATE_SECTIONS,
)

FACT = "array<struct<section:string,key:string,value:string,note:string,seq:int>>"

# Command words under which an agent ships the output of a command.
IP_ROUTE = "ip route show"
IP_ADDR = "ip -o addr show"
SOCKETS = "ss"
NFT = "nft list ruleset"
IPTABLES = "iptables-save"
LSBLK = "lsblk"
RPM = "rpm"
DPKG = "dpkg-query"
UNITS = "systemctl list-units"
UNIT_FILES = "systemctl list-unit-files"
GETENFORCE = "getenforce"
# A symbolic link is shipped with its target as content.
LOCALTIME = "/etc/localtime"

SYSCTL_ROOT = "/proc/sys/"
SYSCTL_TREES = ["net", "vm", "kernel", "fs"]

# Capture used only when the snapshot lacks the preferred one.
FALLBACKS = {
    "/proc/net/route": IP_ROUTE,
    LOCALTIME: "/etc/timezone",
    IPTABLES: NFT,
    DPKG: RPM,
}


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob whose star stays inside one folder."""
    return "^" + "[^/]*".join(part.replace(".", r"\.") for part in pattern.split("*")) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns))


def fact(section: str, key: Column, value: Column, note: Column | None = None,
         seq: Column | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"), key.alias("key"), value.alias("value"),
        (F.lit("") if note is None else note).alias("note"),
        (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
    )


def per_line(lines: Column, make) -> Column:
    """One fact per line; ``make(line, words, position)`` gives it, or NULL to drop the line."""
    made = F.transform(lines, lambda line, i: make(line, words(line), i))
    return F.filter(made, lambda f: f.isNotNull())


def first_of_key(facts: Column) -> Column:
    """Of facts with equal keys the first one: sorted by key, each next to the one before."""
    by_key = F.array_sort(F.transform(facts, lambda f: F.struct(f["key"], f["seq"], f.alias("fact"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(by_key, lambda x: x["key"]))
    paired = F.zip_with(by_key, before, lambda x, key: F.struct(
        x["fact"].alias("fact"), (x["key"].isNotNull() & ~x["key"].eqNullSafe(key)).alias("first")))
    return F.transform(F.filter(paired, lambda p: p["first"]), lambda p: p["fact"])


def single(section: str, key: str | Column, value: Column, when: Column | None = None) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    one = F.array(fact(section, key, value))
    return one if when is None else F.when(when, one)


def _after(line: Column, prefix: str) -> Column:
    return F.substring(line, F.lit(len(prefix) + 1), F.length(line))


def _system(path: Column, content: Column, lines: Column) -> list[tuple[Column, Column]]:
    def plain(file: str, key: str) -> tuple[Column, Column]:
        made = F.when(content != "", fact("system", F.lit(key), strip(content)))
        # A file below the kernel parameter tree is a kernel parameter as well.
        also = _sysctl_fact(path, content) if file.startswith(SYSCTL_ROOT) else F.lit(None)
        return path == file, F.array_compact(F.array(made, also))

    def release(line: Column, ws: Column, i: Column) -> Column:
        def unquoted(prefix: str, key: str) -> Column:
            value = F.regexp_replace(_after(line, prefix), '^"+|"+$', "")
            return F.when(
                line.startswith(prefix) & (value != ""), fact("system", F.lit(key), strip(value), seq=i)
            )

        return F.coalesce(unquoted("PRETTY_NAME=", "os"), unquoted("VERSION_ID=", "os.version_id"))

    cpus = F.size(F.filter(lines, lambda line: line.startswith("processor")))
    models = F.filter(
        F.transform(
            F.filter(lines, lambda line: line.startswith("model name") & line.contains(":")),
            lambda line: strip(F.regexp_replace(line, "^[^:]*:", "")),
        ),
        lambda m: m != "",
    )
    model = F.get(models, 0)
    cpu_facts = F.array_compact(F.array(
        F.when(cpus > 0, fact("system", F.lit("cpu.count"), cpus.cast("string"))),
        F.when(model.isNotNull(), fact("system", F.lit("cpu.model"), model)),
    ))
    total = strip(_after(
        F.get(F.filter(lines, lambda line: line.startswith("MemTotal:")), 0), "MemTotal:"
    ))
    return [
        plain("/proc/sys/kernel/osrelease", "kernel"),
        plain("/proc/sys/kernel/hostname", "hostname"),
        plain("/proc/sys/kernel/version", "kernel.build"),
        plain("/proc/cmdline", "boot.cmdline"),
        plain("/etc/timezone", "timezone"),
        (path == "/etc/os-release", per_line(lines, release)),
        (path == LOCALTIME, single("system", "timezone", F.regexp_replace(strip(content), "^.*/", ""))),
        (path == "/proc/cpuinfo", cpu_facts),
        (path == "/proc/meminfo", single("system", "mem.total", total, F.coalesce(total, F.lit("")) != "")),
    ]


def _sysctl_key(path: Column) -> Column:
    return F.replace(_after(path, SYSCTL_ROOT), F.lit("/"), F.lit("."))


def _sysctl_fact(path: Column, content: Column) -> Column:
    """Kernel parameter of one line that is configuration, else NULL."""
    value = strip(F.translate(content, "\t", " "))
    key = _sysctl_key(path)
    kept = (value != "") & ~value.contains("\n") & ~is_volatile(key)
    return F.when(kept, fact("sysctl", key, value))


def _sysctl(path: Column, content: Column) -> list[tuple[Column, Column]]:
    key = _sysctl_key(path)
    owned = path.startswith(SYSCTL_ROOT) & key.isin(SECURITY_SYSCTL)
    tree = path.rlike(f"^{SYSCTL_ROOT}({'|'.join(SYSCTL_TREES)})/")
    return [
        (owned, single("security", key, strip(content), content != "")),
        (tree, F.array_compact(F.array(_sysctl_fact(path, content)))),
    ]


def _network(path: Column, content: Column, lines: Column) -> list[tuple[Column, Column]]:
    def route(line, ws, i):
        return fact("network", F.concat(F.lit("route:"), word(ws, 0)), line, seq=i)

    def kernel_route(line, ws, i):
        key = F.concat(F.lit("route:"), word(ws, 0), F.lit(":"), word(ws, 1))
        return F.when((i > 0) & (F.size(ws) >= 2), fact("network", key, line, seq=i))

    def address(line, ws, i):
        key = F.concat(F.lit("addr:"), word(ws, 1), F.lit(":"), word(ws, 3))
        value = F.concat_ws(" ", word(ws, 2), word(ws, 3))
        return F.when(
            (F.size(ws) >= 4) & word(ws, 2).isin("inet", "inet6"), fact("network", key, value, seq=i)
        )

    def resolver(line, ws, i):
        wanted = line.startswith("nameserver") | line.startswith("search")
        return F.when(wanted, fact("network", F.concat(F.lit("resolv:"), line), line, seq=i))

    return [
        (path == IP_ROUTE, per_line(lines, route)),
        (path == "/proc/net/route", per_line(lines, kernel_route)),
        (path == IP_ADDR, per_line(lines, address)),
        (path == "/etc/resolv.conf", per_line(lines, resolver)),
        (path == "/etc/hosts", single("network", "hosts.hash", hash12(content))),
    ]


def _listen(path: Column, lines: Column) -> list[tuple[Column, Column]]:
    def socket(line, ws, i):
        users = F.when(line.contains("users:"), F.regexp_extract(line, "users:.*", 0))
        proc = F.coalesce(first_quoted(users), F.lit(""))
        key = F.concat_ws(" ", word(ws, 0), word(ws, 4))
        return F.when(F.size(ws) >= 5, fact("listen", key, proc, note=proc, seq=i))

    return [(path == SOCKETS, first_of_key(per_line(lines, socket)))]


def _firewall(path: Column, content: Column, lines: Column) -> list[tuple[Column, Column]]:
    some = strip(content) != ""
    rules = F.array_join(F.filter(lines, lambda line: ~line.startswith("#")), "\n")
    return [
        (path == NFT, single("firewall", "nftables.ruleset.hash", hash12(content), some)),
        (path == IPTABLES, single("firewall", "iptables.rules.hash", hash12(rules), some)),
    ]


def _storage(path: Column, content: Column, lines: Column) -> list[tuple[Column, Column]]:
    def mount(line, ws, i):
        value = F.concat_ws(" ", word(ws, 0), word(ws, 2), word(ws, 3))
        kept = (F.size(ws) >= 4) & ~word(ws, 0).startswith("cgroup") & (word(ws, 1) != "/proc")
        return F.when(kept, fact("storage", F.concat(F.lit("mount:"), word(ws, 1)), value, seq=i))

    def array(line, ws, i):
        key = F.concat(F.lit("mdraid:"), word(ws, 0))
        return F.when(line.startswith("md"), fact("storage", key, line, seq=i))

    def block(line, ws, i):
        name = F.regexp_replace(word(ws, 0), "^[|`\\- ]+", "")
        value = F.concat_ws(" ", word(ws, 1), word(ws, 2))
        return F.when(F.size(ws) >= 3, fact("storage", F.concat(F.lit("blk:"), name), value, seq=i))

    return [
        (path == "/proc/mounts", per_line(lines, mount)),
        (path == "/etc/fstab", single("storage", "fstab.hash", hash12(content))),
        (path == "/proc/mdstat", per_line(lines, array)),
        (path == LSBLK, per_line(lines, block)),
    ]


def _services(path: Column, lines: Column) -> list[tuple[Column, Column]]:
    def unit(line, ws, i):
        state = F.concat_ws("/", word(ws, 2), word(ws, 3))
        kept = (F.size(ws) >= 4) & word(ws, 0).endswith(".service")
        return F.when(kept, fact("services", word(ws, 0), state, seq=i))

    def unit_file(line, ws, i):
        kept = (F.size(ws) >= 2) & word(ws, 0).endswith(".service")
        key = F.concat(F.lit("enabled:"), word(ws, 0))
        return F.when(kept, fact("services", key, word(ws, 1), seq=i))

    return [(path == UNITS, per_line(lines, unit)), (path == UNIT_FILES, per_line(lines, unit_file))]


def _packages(path: Column, lines: Column) -> list[tuple[Column, Column]]:
    def package(line, ws, i):
        return F.when(F.size(ws) == 2, fact("packages", word(ws, 0), word(ws, 1), seq=i))

    def module(line, ws, i):
        return fact("modules", word(ws, 0), F.lit("loaded"), seq=i)

    return [
        (path.isin(RPM, DPKG), per_line(lines, package)),
        (path == "/proc/modules", per_line(lines, module)),
    ]


def _fingerprints(path: Column, content: Column) -> list[tuple[Column, Column]]:
    keys = F.concat(F.lit("authorized_keys:"), path)
    return [
        (path == GETENFORCE, single("security", "selinux", strip(content), content != "")),
        (path == "/sys/module/apparmor/parameters/enabled",
         single("security", "apparmor", strip(content), content != "")),
        (path == "/etc/sudoers", single("security", "sudoers.hash", hash12(content))),
        (matches_any(path, KEY_FILES), single("security", keys, hash12(content))),
        (matches_any(path, CRON_FILES), single("cron", path, hash12(content))),
        (matches_any(path, CONFIG_FILES), single("configs", path, hash12(content))),
    ]


def capture_facts(path: Column, content: Column) -> Column:
    """All facts of one capture, as an array; NULL for a capture that is not known."""
    lines = clean_lines(content)
    branches = [
        *_system(path, content, lines), *_sysctl(path, content),
        *_network(path, content, lines), *_listen(path, lines),
        *_firewall(path, content, lines), *_storage(path, content, lines),
        *_services(path, lines), *_packages(path, lines), *_fingerprints(path, content),
    ]
    expr = F.when(branches[0][0], branches[0][1].cast(FACT))
    for match, made in branches[1:]:
        expr = expr.when(match, made.cast(FACT))
    return expr


def preferred_captures(captures: DataFrame) -> DataFrame:
    """Drops a fallback capture where the snapshot has the preferred one."""
    path = F.col("path")
    instead_of = F.create_map(*[F.lit(x) for kv in FALLBACKS.items() for x in kv])
    usable = (path != NFT) | (strip(F.col("content")) != "")
    better = captures.where(path.isin(list(FALLBACKS.values())) & usable).select(
        "host", "taken", path.alias("better")
    )
    is_fallback = path.isin(list(FALLBACKS))
    kept = (
        captures.where(is_fallback)
        .withColumn("better", F.element_at(instead_of, path))
        .join(better, ["host", "taken", "better"], "left_anti")
        .select(*captures.columns)
    )
    return captures.where(~is_fallback).unionByName(kept)


def parse_facts(captures: DataFrame) -> DataFrame:
    """(host, taken, section, key, value, note, seq) of all captures.

    Of a socket that is listed twice the first line stands.  Elsewhere a
    repeated key is kept, with ``seq`` telling the order; the last one counts
    when states are compared.
    """
    chosen = preferred_captures(captures.select("host", "taken", "path", "content"))
    return chosen.select(
        "host", "taken", F.inline(capture_facts(F.col("path"), F.col("content")))
    )


def parse_sections(captures: DataFrame, facts: DataFrame) -> DataFrame:
    """All sections of every snapshot with title and, when skipped, the reason.

    A section that has facts is never skipped.  Package and module sections
    whose listing arrived but was empty count as collected.
    """
    delivered = {"listen": [SOCKETS], "packages": [RPM, DPKG], "modules": ["/proc/modules"]}
    section_of_path = F.lit(None).cast("string")
    for section, paths in delivered.items():
        section_of_path = F.when(F.col("path").isin(paths), section).otherwise(section_of_path)
    present = (
        captures.select("host", "taken", section_of_path.alias("section"))
        .unionByName(facts.select("host", "taken", "section"))
        .groupBy("host", "taken")
        .agg(F.collect_set("section").alias("present"))
    )
    known = F.array(*[
        F.struct(
            F.lit(name).alias("section"), F.lit(title).alias("title"),
            F.lit(reason or "").alias("reason"),
        )
        for name, title, reason in STATE_SECTIONS
    ])
    return present.select("host", "taken", "present", F.inline(known)).select(
        "host", "taken", "section", "title",
        F.when(F.array_contains("present", F.col("section")), "")
        .otherwise(F.col("reason")).alias("skipped"),
    )
