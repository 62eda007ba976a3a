import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from opsdiff.operators import facts as etl
from opsdiff.operators.state import state_diff
from tests.helpers import dicts, tuples

T = datetime(2024, 3, 1)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def captures(spark, files, host="h"):
    return spark.createDataFrame([(host, T, p, c) for p, c in files.items()], "host string, taken timestamp_ntz, path string, content string")


def parse(spark, files, section=None):
    df = etl.parse_facts(captures(spark, files))
    got = tuples(df if section is None else df.where(F.col("section") == section), "section", "key", "value")
    return [g[1:] for g in got] if section else got


def test_system(spark):
    got = dict(parse(spark, {
        "/proc/sys/kernel/osrelease": "6.1.0-9\n", "/proc/sys/kernel/hostname": "web1\n", "/proc/sys/kernel/version": "#1 SMP\n",
        "/etc/os-release": 'NAME="X"\nPRETTY_NAME="Linux 12 (x)"\nVERSION_ID="12"\nVERSION="12"\n', "/proc/cmdline": "ro quiet\n",
        "/etc/timezone": "Etc/UTC\n", "/etc/localtime": "/usr/share/zoneinfo/Europe/Oslo",
        "/proc/cpuinfo": "processor : 0\nmodel name : Cpu A: x\n\nprocessor : 1\nmodel name : Cpu B\n",
        "/proc/meminfo": "MemTotal:   100 kB\nMemFree: 1 kB\nMemTotal: 7 kB\n",
    }, "system"))
    assert got == {
        "kernel": "6.1.0-9", "hostname": "web1", "kernel.build": "#1 SMP", "os": "Linux 12 (x)", "os.version_id": "12",
        "boot.cmdline": "ro quiet", "timezone": "Etc/UTC", "cpu.count": "2", "cpu.model": "Cpu A: x", "mem.total": "100 kB"}
    assert dict(parse(spark, {"/etc/localtime": "/usr/share/zoneinfo/Europe/Oslo"}, "system")) == {"timezone": "Oslo"}


def test_sysctl_and_security(spark):
    got = parse(spark, {
        "/proc/sys/vm/swappiness": "60\n", "/proc/sys/net/ipv4/tcp_mem": "1\t2\t3\n", "/proc/sys/kernel/random/uuid": "u\n",
        "/proc/sys/user/max": "1\n", "/proc/sys/net/ipv4/ip_forward": "0\n", "/proc/sys/kernel/multi": "a\nb\n", "/proc/sys/fs/empty": "\n",
        "/proc/sys/kernel/hostname": "web\n", "/proc/sys/dev/x": "1\n", "getenforce": "Enforcing\n", "/sys/module/apparmor/parameters/enabled": "Y\n",
        "/etc/sudoers": "root ALL\n", "/home/bob/.ssh/authorized_keys": "k\n", "/home/a/b/.ssh/authorized_keys": "k\n", "/root/.ssh/authorized_keys": "r\n",
    })
    assert got == sorted([
        ("sysctl", "vm.swappiness", "60"), ("sysctl", "net.ipv4.tcp_mem", "1 2 3"), ("sysctl", "kernel.hostname", "web"), ("system", "hostname", "web"),
        ("security", "net.ipv4.ip_forward", "0"), ("security", "selinux", "Enforcing"), ("security", "apparmor", "Y"),
        ("security", "sudoers.hash", digest("root ALL\n")), ("security", "authorized_keys:/home/bob/.ssh/authorized_keys", digest("k\n")),
        ("security", "authorized_keys:/root/.ssh/authorized_keys", digest("r\n"))], key=repr)


def test_packages_and_modules(spark):
    assert parse(spark, {"rpm": "bash 5.2-1\nodd\nthree words here\n", "dpkg-query": "zsh 5\n", "/proc/modules": "ext4 1 2 - Live\n\nxfs 1\n"}) == sorted([
        ("packages", "bash", "5.2-1"), ("modules", "ext4", "loaded"), ("modules", "xfs", "loaded")], key=repr)
    assert parse(spark, {"dpkg-query": "zsh 5\n"}, "packages") == [("zsh", "5")]


def test_network(spark):
    got = parse(spark, {
        "ip route show": "default via 10.0.0.1 dev eth0\n10.0.0.0/8 dev eth0\n", "/proc/net/route": "Iface Dest\neth0 0000 x\n",
        "ip -o addr show": "1: lo    inet 127.0.0.1/8 scope host lo\n2: eth0    link/ether aa:bb\n2: eth0    inet6 fe80::1/64 scope link\n",
        "/etc/resolv.conf": "# c\nnameserver 10.0.0.2\nsearch a b\noptions x\n", "/etc/hosts": "127.0.0.1 l\n",
    }, "network")
    assert got == sorted([
        ("route:default", "default via 10.0.0.1 dev eth0"), ("route:10.0.0.0/8", "10.0.0.0/8 dev eth0"), ("addr:lo:127.0.0.1/8", "inet 127.0.0.1/8"),
        ("addr:eth0:fe80::1/64", "inet6 fe80::1/64"), ("resolv:nameserver 10.0.0.2", "nameserver 10.0.0.2"), ("resolv:search a b", "search a b"),
        ("hosts.hash", digest("127.0.0.1 l\n"))], key=repr)
    assert parse(spark, {"/proc/net/route": "Iface Dest\neth0 0000 x\nshort\n"}, "network") == [("route:eth0:0000", "eth0 0000 x")]


def test_listen_first_line_stands(spark):
    df = etl.parse_facts(captures(spark, {"ss": (
        'udp UNCONN 0 0 0.0.0.0:53 *:*\ntcp LISTEN 0 128 0.0.0.0:22 *:* users:(("sshd",pid=1,fd=3))\n'
        'tcp LISTEN 0 128 0.0.0.0:22 *:* users:(("other",pid=2,fd=3))\nshort line\n')}))
    assert tuples(df, "key", "value", "note") == [("tcp 0.0.0.0:22", "sshd", "sshd"), ("udp 0.0.0.0:53", "", "")]


def test_firewall(spark):
    tables = "# Generated\n*filter\n  -A INPUT x\n# done\n"
    assert parse(spark, {"iptables-save": tables}, "firewall") == [("iptables.rules.hash", digest("*filter\n-A INPUT x"))]
    assert parse(spark, {"iptables-save": tables, "nft list ruleset": "table t\n"}, "firewall") == [("nftables.ruleset.hash", digest("table t\n"))]
    # an empty ruleset does not count as delivered
    assert parse(spark, {"iptables-save": tables, "nft list ruleset": " \n"}, "firewall") == [("iptables.rules.hash", digest("*filter\n-A INPUT x"))]


def test_storage(spark):
    got = parse(spark, {
        "/proc/mounts": "/dev/sda1 / ext4 rw 0 0\ncgroup2 /sys/fs/cgroup cgroup2 rw 0 0\nproc /proc proc rw 0 0\nshort /x\n", "/etc/fstab": "f\n",
        "/proc/mdstat": "Personalities : [raid1]\nmd0 : active raid1 sda sdb\n", "lsblk": "sda 10G disk\n|-sda1 9G part\n`-sda2 1G part\n",
    }, "storage")
    assert got == sorted([
        ("mount:/", "/dev/sda1 ext4 rw"), ("fstab.hash", digest("f\n")), ("mdraid:md0", "md0 : active raid1 sda sdb"),
        ("blk:sda", "10G disk"), ("blk:sda1", "9G part"), ("blk:sda2", "1G part")], key=repr)


def test_services_cron_configs(spark):
    got = parse(spark, {
        "systemctl list-units": "ssh.service loaded active running OpenSSH\nx.socket loaded active y\nshort.service a\n",
        "systemctl list-unit-files": "ssh.service enabled enabled\nx.timer enabled\n", "/etc/crontab": "c\n", "/etc/cron.d/job": "j\n",
        "/etc/cron.d/sub/job": "no\n", "/var/spool/cron/crontabs/root": "r\n", "/etc/ssh/sshd_config": "s\n", "/etc/nginx/conf.d/a.conf": "n\n", "/etc/pcp.conf": "p\n", "/etc/pcpXconf": "no\n",
    })
    assert got == sorted([
        ("services", "ssh.service", "active/running"), ("services", "enabled:ssh.service", "enabled"), ("cron", "/etc/crontab", digest("c\n")),
        ("cron", "/etc/cron.d/job", digest("j\n")), ("cron", "/var/spool/cron/crontabs/root", digest("r\n")), ("configs", "/etc/ssh/sshd_config", digest("s\n")),
        ("configs", "/etc/nginx/conf.d/a.conf", digest("n\n")), ("configs", "/etc/pcp.conf", digest("p\n"))], key=repr)


def test_repeated_route_last_line_counts(spark):
    one = etl.parse_facts(captures(spark, {"ip route show": "default via 1\ndefault via 2\n"}))
    two = etl.parse_facts(captures(spark, {"ip route show": "default via 2\n"}))
    assert one.count() == 2 and state_diff(one, two).count() == 0


def test_sections_and_reasons(spark):
    caps = captures(spark, {"/proc/modules": "", "/etc/crontab": "c\n", "/etc/unknown": "x"})
    got = {r["section"]: r["skipped"] for r in dicts(etl.parse_sections(caps, etl.parse_facts(caps)))}
    assert len(got) == 12
    assert {s for s, reason in got.items() if reason == ""} == {"modules", "cron", "network", "storage", "system"}
    assert "package" in got["packages"]


def test_glob():
    import re
    hit = lambda pattern, path: bool(re.match(etl.glob_regex(pattern), path))
    assert hit("/etc/a.d/*", "/etc/a.d/x") and not hit("/etc/a.d/*", "/etc/a.d/x/y") and not hit("/etc/a.d/*", "/etc/aXd/x")
    assert hit("/etc/p/*.config", "/etc/p/z.config") and not hit("/etc/p/*.config", "/etc/p/z.conf")
