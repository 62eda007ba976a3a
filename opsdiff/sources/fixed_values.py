"""Values that decide results: metric catalog, trend presets, diagnosis rules,
state sections and sysctl keys.

Fixed values: names, polarities, thresholds, floors, severities and conditions
have to be exactly these for reports to come out right.  Labels, conclusions
and next steps are free text and are this library's own.
"""

# Category headings in report order; below each, one metric per line:
# name, polarity, own threshold in percent, absolute floor, flags.
# "-" means "use the threshold of the request" or "no floor".
METRIC_TABLE = """
[CPU]
kernel.all.cpu.user                   worse_up     -     10 core
kernel.all.cpu.sys                    worse_up     -     10 core
kernel.all.cpu.nice                   neutral      -     10
kernel.all.cpu.idle                   better_up    -      -
kernel.all.cpu.wait.total             worse_up     -     10 core
kernel.all.cpu.irq.hard               worse_up     -     10
kernel.all.cpu.irq.soft               worse_up     -     10
kernel.all.cpu.steal                  worse_up     -     10 core
kernel.all.cpu.guest                  neutral      -     10
kernel.all.load                       worse_up     -    0.5 core
kernel.all.runnable                   worse_up     -      2 core
kernel.all.blocked                    worse_up     -      1
kernel.all.nprocs                     neutral      -      -
kernel.all.pswitch                    worse_up     -      -
kernel.all.intr                       neutral    100      -
kernel.all.sysfork                    neutral    100      -
kernel.all.uptime                     neutral      -      -
kernel.all.entropy.avail              neutral    100      -
kernel.all.pressure.cpu.some.avg      worse_up     -      1 core
kernel.percpu.cpu.user                worse_up     -     10 fold
kernel.percpu.cpu.sys                 worse_up     -     10 fold
kernel.percpu.cpu.wait.total          worse_up     -     10 fold
kernel.percpu.cpu.irq.soft            worse_up     -     10 fold
[Memory]
mem.util.available                    better_up    -      - core
mem.util.free                         better_up    -      -
mem.util.cached                       neutral      -      -
mem.util.bufmem                       neutral      -      -
mem.util.dirty                        worse_up     -  51200
mem.util.writeback                    worse_up     -  51200
mem.util.slab                         neutral      -      -
mem.util.anonpages                    neutral      -      -
mem.util.mapped                       neutral      -      -
mem.util.shmem                        neutral      -  51200
mem.util.swapCached                   neutral      -      -
mem.util.committed_AS                 worse_up     -      -
mem.util.pageTables                   neutral      -      -
swap.free                             better_up    -      -
swap.pagesin                          worse_up     -      1 core
swap.pagesout                         worse_up     -      1 core
mem.vmstat.pgmajfault                 worse_up     -      1
mem.vmstat.pgfault                    neutral    150      -
mem.vmstat.oom_kill                   worse_up     -      - core
mem.vmstat.pgscan_direct              worse_up     -      1 core
mem.vmstat.pgscan_kswapd              worse_up     -      -
mem.vmstat.allocstall                 worse_up     -      -
mem.vmstat.compact_stall              worse_up     -      -
mem.vmstat.thp_fault_alloc            neutral    200      -
mem.vmstat.thp_collapse_alloc         neutral    200      -
mem.vmstat.pgactivate                 neutral    200     50
mem.vmstat.pgdeactivate               neutral    200     50
kernel.all.pressure.memory.some.avg   worse_up     -      1 core
kernel.all.pressure.memory.full.avg   worse_up     -      1
[Disk I/O]
disk.all.read                         neutral      -      5
disk.all.write                        neutral      -      5
disk.all.read_bytes                   neutral      -    512
disk.all.write_bytes                  neutral      -    512
disk.all.total                        neutral      -      5
disk.all.read_merge                   neutral      -      5
disk.all.write_merge                  neutral      -      5
disk.all.avactive                     worse_up     -      - core
disk.all.aveq                         worse_up     -      - core
disk.dev.read                         neutral      -      5
disk.dev.write                        neutral      -      5
disk.dev.read_bytes                   neutral      -    512
disk.dev.write_bytes                  neutral      -    512
disk.dev.total                        neutral      -      5
disk.dev.avactive                     worse_up     -      - core
disk.dev.aveq                         worse_up     -      - core
disk.dm.read                          neutral      -      5
disk.dm.write                         neutral      -      5
disk.dm.read_bytes                    neutral      -    512
disk.dm.write_bytes                   neutral      -    512
disk.dm.avactive                      worse_up     -      -
disk.dm.aveq                          worse_up     -      -
disk.md.read                          neutral      -      5
disk.md.write                         neutral      -      5
disk.md.read_bytes                    neutral      -    512
disk.md.write_bytes                   neutral      -    512
kernel.all.pressure.io.some.avg       worse_up     -      1 core
kernel.all.pressure.io.full.avg       worse_up     -      1
[Filesystem]
filesys.full                          worse_up     -      - core
filesys.free                          better_up    -      -
filesys.usedfiles                     worse_up     -      -
vfs.files.count                       neutral      -      -
vfs.inodes.count                      neutral      -      -
vfs.dentry.count                      neutral      -      -
filesys.avail                         better_up    -      -
[Network]
network.interface.in.bytes            neutral      -  10240
network.interface.out.bytes           neutral      -  10240
network.interface.in.packets          neutral      -     50
network.interface.out.packets         neutral      -     50
network.interface.in.errors           worse_up     -      - core
network.interface.out.errors          worse_up     -      -
network.interface.in.drops            worse_up     -      - core
network.interface.out.drops           worse_up     -      - core
network.interface.collisions          worse_up     -      -
network.tcp.insegs                    neutral    150     50
network.tcp.outsegs                   neutral    150     50
network.tcp.retranssegs               worse_up     -      1 core
network.tcp.inerrs                    worse_up     -      -
network.tcp.outrsts                   worse_up     -      1
network.tcp.timeouts                  worse_up     -      -
network.tcp.currestab                 neutral      -     10
network.tcp.activeopens               neutral      -      1
network.tcp.passiveopens              neutral      -      1
network.tcp.estabresets               worse_up     -      1
network.tcp.attemptfails              worse_up     -      1
network.tcp.listendrops               worse_up     -      - core
network.tcp.listenoverflows           worse_up     -      - core
network.tcp.syncookiessent            worse_up     -      -
network.tcp.syncookiesrecv            neutral      -      -
network.tcp.syncookiesfailed          worse_up     -      -
network.udp.indatagrams               neutral    150     50
network.udp.outdatagrams              neutral    150     50
network.udp.inerrors                  worse_up     -      -
network.udp.noports                   neutral      -      -
network.udp.recvbuferrors             worse_up     -      -
network.udp.sndbuferrors              worse_up     -      -
network.sockstat.tcp.inuse            neutral      -     10
network.sockstat.tcp.alloc            neutral      -     10
network.sockstat.tcp.tw               neutral      -     10
network.sockstat.tcp.orphan           worse_up     -      1
network.sockstat.udp.inuse            neutral      -      -
network.softnet.dropped               worse_up     -      - core
network.softnet.time_squeeze          worse_up     -      -
network.softnet.processed             neutral    150    100
network.tcpconn.established           neutral      -      -
network.tcpconn.time_wait             neutral      -      -
network.tcpconn.close_wait            worse_up     -      -
network.tcpconn.syn_recv              worse_up     -      -
network.tcpconn.listen                neutral      -      -
network.tcp.prunecalled               worse_up     -      -
network.tcp.rcvcollapsed              worse_up     -      -
network.tcp.delayedacks               neutral    200      -
network.icmp.inmsgs                   neutral    300     20
network.icmp.outmsgs                  neutral    300     20
network.icmp.inerrors                 worse_up     -      -
network.icmp.indestunreachs           neutral    300      -
network.ip.inreceives                 neutral    150    100
network.ip.outrequests                neutral    150    100
network.ip.inhdrerrors                worse_up     -      -
network.ip.indiscards                 worse_up     -      -
network.ip.outdiscards                worse_up     -      -
network.ip.forwdatagrams              neutral    150     50
network.ip.fragfails                  worse_up     -      -
network.ip.reasmfails                 worse_up     -      -
"""

# Metrics whose regression may turn a resource block red carry "core" above;
# metrics whose instances are folded into one line carry "fold".

# The slim catalog, for a main-signal view, leaves out metrics that start like this.
SLIM_LEAVES_OUT = [
    "kernel.all.entropy.", "kernel.percpu.", "mem.vmstat.thp_", "mem.vmstat.pgactivate",
    "mem.vmstat.pgdeactivate", "disk.dm.", "disk.md.", "network.tcpconn.",
    "network.tcp.delayedacks", "network.icmp.", "network.ip.",
]

# Category -> resource block; other categories belong to no block.
RESOURCE_OF_CATEGORY = {
    "CPU": "cpu",
    "Memory": "mem",
    "Disk I/O": "disk",
    "Filesystem": "disk",
    "Network": "net",
}

# Resource blocks in board order.
RESOURCE_BLOCKS = [("cpu", "CPU"), ("mem", "Memory"), ("disk", "Disk"), ("net", "Network")]

# Trend presets: key, label, metrics.
TREND_PRESETS = [
    ("cpu", "CPU time by mode", [
        "kernel.all.cpu.user", "kernel.all.cpu.sys",
        "kernel.all.cpu.wait.total", "kernel.all.cpu.steal"]),
    ("load", "Load average", ["kernel.all.load"]),
    ("mem", "Memory available", ["mem.util.available"]),
    ("disk", "Disk bytes", ["disk.all.read_bytes", "disk.all.write_bytes"]),
    ("net", "Interface bytes", ["network.interface.in.bytes", "network.interface.out.bytes"]),
    ("tcp", "TCP retransmission and open connections", [
        "network.tcp.retranssegs", "network.tcp.currestab"]),
    ("sock", "TCP sockets by state", [
        "network.sockstat.tcp.alloc", "network.sockstat.tcp.tw", "network.sockstat.tcp.orphan"]),
    ("psi", "Pressure stall (some)", [
        "kernel.all.pressure.cpu.some.avg", "kernel.all.pressure.memory.some.avg",
        "kernel.all.pressure.io.some.avg"]),
]

# Diagnosis rules in evaluation order.  Every condition of a rule has to hold.
DIAGNOSIS_RULES = [
    {"id": "swap-spiral", "severity": "crit",
     "conclusion": "Memory is short and pages are being swapped out",
     "next": ["free -m", "vmstat 1 5"],
     "when": [{"metric": "swap.pagesout", "verdict": "worse", "b_gt_zero": True},
              {"metric": "mem.util.available", "verdict": "worse"}]},
    {"id": "direct-reclaim", "severity": "crit",
     "conclusion": "Allocations have to reclaim memory themselves and may stall",
     "next": ["grep pgscan_direct /proc/vmstat"],
     "when": [{"metric": "mem.vmstat.pgscan_direct", "verdict": "worse", "b_gt_zero": True}]},
    {"id": "oom", "severity": "crit",
     "conclusion": "The kernel killed processes because memory ran out",
     "next": ["journalctl -k | grep -i 'killed process'"],
     "when": [{"metric": "mem.vmstat.oom_kill", "verdict": "worse", "b_gt_zero": True}]},
    {"id": "disk-saturated", "severity": "crit",
     "conclusion": "A disk is busy longer and its queue has grown",
     "next": ["iostat -x 1 5"],
     "when": [{"metric": "disk.dev.avactive", "verdict": "worse"},
              {"metric": "disk.dev.aveq", "verdict": "worse"}]},
    {"id": "iowait-drag", "severity": "warn",
     "conclusion": "Processors wait for storage",
     "next": ["iostat -x 1 5", "pidstat -d 1 5"],
     "when": [{"metric": "kernel.all.cpu.wait.total", "verdict": "worse"},
              {"metric": "disk.all.avactive", "verdict": "worse"}]},
    {"id": "accept-overflow", "severity": "crit",
     "conclusion": "Listening sockets drop connections: accept queues are full",
     "next": ["ss -lnt", "nstat -az TcpExtListenDrops"],
     "when": [{"metric": "network.tcp.listendrops", "b_gt_zero": True}]},
    {"id": "syn-pressure", "severity": "warn",
     "conclusion": "Half-open connections overflow, SYN cookies are being sent",
     "next": ["ss -s", "nstat -az TcpExtSyncookiesSent"],
     "when": [{"metric": "network.tcp.syncookiessent", "verdict": "worse", "b_gt_zero": True}]},
    {"id": "softnet-drop", "severity": "crit",
     "conclusion": "Packets are dropped before the network stack sees them",
     "next": ["cat /proc/net/softnet_stat"],
     "when": [{"metric": "network.softnet.dropped", "verdict": "worse", "b_gt_zero": True}]},
    {"id": "single-core-hot", "severity": "warn",
     "conclusion": "Soft interrupts pile up on single processors",
     "next": ["mpstat -P ALL 1 5"],
     "when": [{"metric": "kernel.percpu.cpu.irq.soft", "verdict": "worse", "delta_gte": 200.0}]},
    {"id": "steal", "severity": "warn",
     "conclusion": "The hypervisor gives this guest less processor time",
     "next": ["vmstat 1 5"],
     "when": [{"metric": "kernel.all.cpu.steal", "verdict": "worse", "delta_gte": 100.0}]},
    {"id": "retrans", "severity": "warn",
     "conclusion": "TCP sends more segments again: the path loses packets",
     "next": ["ss -ti", "ip -s link"],
     "when": [{"metric": "network.tcp.retranssegs", "verdict": "worse", "delta_gte": 100.0}]},
    {"id": "fs-filling", "severity": "crit",
     "conclusion": "A file system is at 90 percent or more and still growing",
     "next": ["df -h"],
     "when": [{"metric": "filesys.full", "verdict": "worse", "b_gte": 90.0}]},
    {"id": "inode-growth", "severity": "warn",
     "conclusion": "The number of files grows unusually fast",
     "next": ["df -i"],
     "when": [{"metric": "filesys.usedfiles", "verdict": "worse", "delta_gte": 50.0}]},
    {"id": "mem-leak", "severity": "warn",
     "conclusion": "Available memory falls while anonymous memory grows: a leak is likely",
     "next": ["ps aux --sort=-rss | head"],
     "when": [{"metric": "mem.util.available", "verdict": "worse"},
              {"metric": "mem.util.anonpages", "delta_gte": 30.0}]},
    {"id": "orphan-pileup", "severity": "warn",
     "conclusion": "TCP connections without an owner accumulate",
     "next": ["ss -s"],
     "when": [{"metric": "network.sockstat.tcp.orphan", "verdict": "worse", "b_gt_zero": True}]},
    {"id": "rebooted", "severity": "info",
     "conclusion": "The machine was started again between the windows",
     "next": ["last reboot"],
     "when": [{"metric": "kernel.all.uptime", "delta_lte": -50.0}]},
]

# State sections in report order: name, title, reason given when it is empty
# (None: an empty section is not reported as skipped).
STATE_SECTIONS = [
    ("network", "Network", None),
    ("listen", "Listening sockets", "no socket listing delivered"),
    ("firewall", "Packet filter", "no packet filter rules delivered"),
    ("storage", "Storage", None),
    ("services", "Services", "no service listing delivered"),
    ("cron", "Scheduled jobs", "no readable job files"),
    ("configs", "Configuration files", "no known configuration files"),
    ("security", "Security settings", "no security settings readable"),
    ("system", "System", None),
    ("sysctl", "Kernel parameters", "no kernel parameters readable"),
    ("packages", "Packages", "no package listing delivered"),
    ("modules", "Kernel modules", "no module listing delivered"),
]

# Kernel parameters that change by themselves; a trailing dot means a prefix.
VOLATILE_SYSCTL = [
    "kernel.random.uuid", "kernel.random.boot_id", "kernel.ns_last_pid",
    "kernel.random.entropy_avail", "fs.dentry-state", "fs.file-nr",
    "fs.inode-nr", "fs.inode-state", "fs.quota", "kernel.sched_domain",
    "kernel.pty.nr", "net.netfilter.nf_conntrack_count",
    "kernel.hung_task_detect_count", "kernel.tainted", "user.",
]

# Kernel parameters reported by the security section instead.
SECURITY_SYSCTL = [
    "net.ipv4.ip_forward",
    "net.ipv4.conf.all.rp_filter",
    "net.ipv4.conf.all.accept_redirects",
    "net.ipv4.tcp_syncookies",
    "kernel.randomize_va_space",
    "kernel.kptr_restrict",
    "kernel.dmesg_restrict",
]

# Process metrics: processor time is the sum of the first two (ms/s), the
# others are resident memory (KB) and start time (ms since the epoch).
PROC_CPU_METRICS = ["hotproc.psinfo.utime", "hotproc.psinfo.stime"]
PROC_RSS_METRIC = "hotproc.psinfo.rss"
PROC_START_METRIC = "hotproc.psinfo.start_time"

# Files that are fingerprinted, as glob patterns.
CRON_FILES = [
    "/etc/crontab", "/etc/cron.d/*", "/etc/cron.hourly/*", "/etc/cron.daily/*",
    "/etc/cron.weekly/*", "/etc/cron.monthly/*", "/var/spool/cron/*",
    "/var/spool/cron/crontabs/*",
]
CONFIG_FILES = [
    "/etc/ssh/sshd_config", "/etc/ssh/sshd_config.d/*", "/etc/security/limits.conf",
    "/etc/security/limits.d/*", "/etc/sysctl.conf", "/etc/sysctl.d/*",
    "/etc/systemd/system.conf", "/etc/systemd/journald.conf", "/etc/selinux/config",
    "/etc/nginx/nginx.conf", "/etc/nginx/conf.d/*", "/etc/pcp/pmlogger/*.config",
    "/etc/pcp.conf", "/etc/profile", "/etc/environment", "/etc/pam.d/*",
]
KEY_FILES = ["/root/.ssh/authorized_keys", "/home/*/.ssh/authorized_keys"]
