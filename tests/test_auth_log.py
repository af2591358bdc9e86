"""Authentication logs: times without a year, users, addresses and commands."""

import os
from datetime import datetime, timezone

from vestige.sources import telemetry as E

LINES = """May  3 10:00:01 host sshd[812]: Accepted publickey for ann from 10.0.0.7 port 22 ssh2
Dec 31 23:59:59 host sudo: ann : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/rm -rf /x
not a line of it
May  3 10:00:02 host sshd[813]: Failed password for invalid user bob from 2001:db8::1 port 9
"""


def test_auth_log(spark, tmp_path):
    path = tmp_path / "auth.log"
    path.write_text(LINES)
    os.utime(path, (datetime(2024, 6, 1, tzinfo=timezone.utc).timestamp(),) * 2)
    assert E.sniff(LINES.splitlines()[0]) == "auth" and E.sniff(LINES.splitlines()[1]) == "auth"
    rows = E.load(spark, str(path)).select("time", "exe", "pid", "user", "dest_ip", "cmdline").collect()
    assert [(r.exe, r.pid, r.user, r.dest_ip, r.cmdline) for r in rows] == [("sshd", 812, "ann", "10.0.0.7", None), ("sudo", None, None, None, "/bin/rm -rf /x"), ("sshd", 813, "bob", "2001:db8::1", None)]
    assert [r.t for r in E.load(spark, str(path)).selectExpr("date_format(time, 'yyyy-MM-dd HH:mm:ss') AS t").collect()] == ["2024-05-03 10:00:01", "2023-12-31 23:59:59", "2024-05-03 10:00:02"]
    assert [r.y for r in E.auth_log(spark, str(path), 2020).selectExpr("year(time) AS y").collect()] == [2020, 2020, 2020]
