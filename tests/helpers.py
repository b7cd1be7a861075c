"""Generated log fixtures with known incidents."""

ATTACKER, SCANNER, TUNNEL, LEAK, GUESSER = "198.51.100.7", "203.0.113.80", "10.1.1.31", "10.1.1.55", "192.0.2.14"


def auth_log() -> str:
    """15 failures, a success and a privileged command; a scan of 18 ports; 9 DNS queries; one malware hit."""
    users = ["admin"] * 11 + ["root"] * 2 + ["oracle", "postgres"]
    out = [f"Mar  3 02:{10 + i // 30:02d}:{i % 30 + 10} web-01 sshd[{100 + i}]: Failed password for invalid user {u} from {ATTACKER} port {50001 + i} ssh2"
           for i, u in enumerate(users)]
    out += [f"Mar  3 02:20:00 web-01 sshd[200]: Accepted password for admin from {ATTACKER} port 50020 ssh2",
            "Mar  3 02:20:01 web-01 sshd[200]: session opened for user admin by (uid=0)",
            f"Mar  3 02:21:05 web-01 audit[201]: privilege escalation by admin from {ATTACKER} COMMAND=/bin/sh", "", "# rotated"]
    out += [f"Mar  3 22:05:02 fw-02 kernel: BLOCK SRC={SCANNER} DST=10.9.0.5 PROTO=TCP DPT={p}" for p in range(20, 38)]
    out += [f"Mar  3 01:52:{i:02d} db-01 named[9]: client {TUNNEL}#53 query: q{i}.example.net IN TXT" for i in range(9)]
    out += ["Mar  3 19:12:44 pc-114 clamd[1]: Trojan malware in /tmp/a.bin"]
    return "\n".join(out) + "\n"


def network_csv() -> str:
    rows = ["timestamp,source_ip,dest_ip,user,host,event_type,status,port"]
    rows += [f"2026-03-03T03:{15 + i}:02,{LEAK},203.0.113.{i},svc,APP-05,outbound_conn,flagged,4444" for i in range(6)]
    rows += [f"2026-03-03T09:41:{10 + i},{GUESSER},10.0.0.7,,GW-01,failed_login,failed,443" for i in range(6)]
    return "\r\n".join(rows)


def write(folder, files: dict) -> list[str]:
    paths = []
    for name, text in files.items():
        path = folder / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        paths.append(str(path))
    return paths
