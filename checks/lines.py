"""Log lines made from the ``events`` table by pure expressions, so that SQL knows every part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources import as_events

# Parts of a line, as expressions over events that Spark SQL and DuckDB read alike.
ACTION = "CASE WHEN event_id % 3 = 0 THEN 'block' ELSE 'pass' END"
DIRECTION = "CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END"
PROTOCOL = "CASE WHEN event_id % 5 < 3 THEN 'tcp' ELSE 'udp' END"
FLAGS = (
    "CASE WHEN event_id % 4 = 0 THEN 'S' WHEN event_id % 4 = 1 THEN 'FA'"
    " WHEN event_id % 4 = 2 THEN 'PA' ELSE 'A' END"
)
PORT = (
    "CASE WHEN event_id % 4 = 0 THEN '22' WHEN event_id % 4 = 1 THEN '53'"
    " WHEN event_id % 4 = 2 THEN '80' ELSE '443' END"
)
SOURCE_IP = "concat('10.', CAST(user_id % 256 AS VARCHAR(9)), '.0.', CAST(event_id % 256 AS VARCHAR(9)))"
TARGET_IP = "concat('203.0.113.', CAST(event_id % 256 AS VARCHAR(9)))"
SOURCE_PORT = "CAST(1024 + event_id % 60000 AS VARCHAR(9))"
RULE_UUID = "CAST(1000000100 + event_id % 12 AS VARCHAR(19))"
INTERFACE = "concat('igb', CAST(user_id % 4 AS VARCHAR(9)))"
HOST = "concat('fw', CAST(user_id % 3 AS VARCHAR(9)))"
MAC = "concat('aa:bb:cc:dd:ee:', CASE WHEN event_id % 2 = 0 THEN '0f' ELSE 'f0' END)"
DOMAIN = "concat('h', CAST(user_id AS VARCHAR(9)), '.site', CAST(event_id % 50 AS VARCHAR(9)), '.example')"
USER = "concat('user', CAST(user_id AS VARCHAR(9)))"
V6_SOURCE = "concat('2001:db8::', CAST(event_id % 10 AS VARCHAR(9)))"


def v6_groups(number: str) -> str:
    """Spark text: a number of up to twelve digits as the last three groups of an IPv6 address, four digits each at most."""
    return f"concat({number} div 100000000, ':', {number} div 10000 % 10000, ':', {number} % 10000)"


def text(sql: str) -> str:
    """The same expression in Spark's spelling."""
    return sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with its time as text."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


def header(program: str, extra: str = " - -") -> str:
    return f"concat('<134>1 ', stamp, ' ', {text(HOST)}, ' {program} ', CAST(event_id AS STRING), '{extra} ')"


def filterlog_text(version: int = 4) -> str:
    """Packet-filter values; an escaped header keeps the field count of real lines."""
    if version == 4:
        middle = (
            f"'4,0x0,,64,0,0,DF,', CASE WHEN event_id % 5 < 3 THEN '6' ELSE '17' END, ',', {PROTOCOL},"
            f" ',60,', {SOURCE_IP}, ',', {TARGET_IP}"
        )
    else:
        middle = (
            f"'6,0x00,0x12345,64,', {PROTOCOL}, ',', CASE WHEN event_id % 5 < 3 THEN '6' ELSE '17' END,"
            f" ',60,', {V6_SOURCE}, ',', 'fe80::1'"
        )
    return text(
        f"concat(CAST(event_id % 7 AS VARCHAR(9)), ',,,', {RULE_UUID}, ',', {INTERFACE}, ',match,', {ACTION},"
        f" ',', {DIRECTION}, ',', {middle}, ',', {SOURCE_PORT}, ',', {PORT}, ',0',"
        f" CASE WHEN event_id % 5 < 3 THEN concat(',', {FLAGS}, ',',"
        " CASE WHEN event_id % 10 = 0 THEN concat(CAST(event_id AS VARCHAR(9)), ':', CAST(event_id + 9 AS VARCHAR(9)))"
        " ELSE '1' END, ',,1024,,mss;TS') ELSE '' END)"
    )


def unbound_text() -> str:
    return text(
        f"concat('[', CAST(user_id AS VARCHAR(9)), ':0] info: ', {SOURCE_IP}, ' ', {DOMAIN}, '. A IN NOERROR"
        " 0.000123 ', CAST(event_id % 2 AS VARCHAR(9)), ' ', CAST(40 + event_id % 100 AS VARCHAR(9)))"
    )


def sshd_text() -> str:
    return text(
        "CASE WHEN event_id % 3 = 0 THEN concat('error: PAM: Authentication error for ', "
        f"{USER}, ' from ', {SOURCE_IP}) WHEN event_id % 3 = 1 THEN concat('Accepted publickey for ',"
        f" {USER}, ' from ', {SOURCE_IP}, ' port 22 ssh2') ELSE 'error: kex reset' END"
    )


def portal_text() -> str:
    return text(
        "CASE WHEN event_id % 3 = 0 THEN concat('/index.php: webConfigurator authentication error for user ''',"
        f" {USER}, ''' from: ', {SOURCE_IP}) WHEN event_id % 3 = 1 THEN concat('/index.php: Successful login"
        f" for user ''', {USER}, ''' from: ', {SOURCE_IP}) ELSE '/status.php: Page viewed' END"
    )


def sshguard_text() -> str:
    return text(
        f"CASE WHEN event_id % 2 = 0 THEN concat('Attack from \"', {SOURCE_IP}, '\" on service unknown service"
        f" with danger ', CAST(event_id % 70 AS VARCHAR(9)), '.') ELSE concat('Blocking \"', {SOURCE_IP}, '/32\""
        " for 120 secs (', CAST(event_id % 9 AS VARCHAR(9)), ' attacks in 22 secs, after 1 abuses over 30 secs.)')"
        " END"
    )


def kea_text() -> str:
    lead = f"'INFO [0x8000] DHCP4_', ?, ' [hwtype=1 ', {MAC}, '], cid=[01:02], tid=0x1f'"
    packet = lead.replace("?", "'PACKET_RECEIVED'")
    lease = lead.replace("?", "'LEASE_ALLOC'")
    return text(
        f"CASE WHEN event_id % 2 = 0 THEN concat({packet}, ': DHCPREQUEST (type 3) received from ', {SOURCE_IP},"
        f" ' to 255.255.255.255 on interface ', {INTERFACE}) ELSE concat({lease}, ': address ', {SOURCE_IP},"
        " ' has been allocated') END"
    )


def eve_text() -> str:
    return text(
        f"""concat('{{"event_type":"alert","src_ip":"', {SOURCE_IP}, '","dest_ip":"', {TARGET_IP},
        '","src_port":', {SOURCE_PORT}, ',"dest_port":', {PORT}, ',"alert":{{"signature":"sig ',
        CAST(event_id % 6 AS VARCHAR(9)), '","severity":', CAST(1 + event_id % 3 AS VARCHAR(9)),
        ',"category":"cat"}},"http":{{"url":"/p', CAST(event_id % 5 AS VARCHAR(9)), '"}}}}')"""
    )


def fast_text() -> str:
    return text(
        f"concat('[1:', CAST(2000 + event_id % 6 AS VARCHAR(9)), ':7] SCAN probe [Classification: Misc] [Priority: ',"
        f" CAST(1 + event_id % 3 AS VARCHAR(9)), '] {{TCP}} ', {SOURCE_IP}, ':', {SOURCE_PORT}, ' -> ', {TARGET_IP},"
        f" ':', {PORT})"
    )


def snort_text() -> str:
    return text(
        f"concat('[1:', CAST(2000 + event_id % 6 AS VARCHAR(9)), ':7] SCAN probe [Classification: Misc] [Priority: ',"
        f" CAST(1 + event_id % 3 AS VARCHAR(9)), '] {{TCP}} ', {SOURCE_IP}, ':', {SOURCE_PORT}, ' -> ', {TARGET_IP},"
        f" ':', {PORT})"
    )


def squid_text() -> str:
    return text(
        f"concat({SOURCE_IP}, ' TCP_MISS/200 ', CAST(100 + event_id % 900 AS VARCHAR(9)), ' GET http://', {DOMAIN},"
        " ':8080/p', CAST(event_id % 5 AS VARCHAR(9)), ' - HIER_DIRECT/', " + TARGET_IP + ", ' text/html')"
    )


def nginx_text() -> str:
    return text(
        f"concat({SOURCE_IP}, ' - ', {USER}, ' [01/Jan/2024:00:00:07 +0000] \"GET /p', CAST(event_id % 5 AS VARCHAR(9)),"
        " ' HTTP/1.1\" 200 ', CAST(100 + event_id % 900 AS VARCHAR(9)), ' \"-\" \"agent x\"')"
    )


def haproxy_text() -> str:
    return text(
        f"concat({SOURCE_IP}, ':', {SOURCE_PORT}, ' [01/Jan/2024:00:00:07.123] front back/srv ', "
        "CAST(event_id % 4 AS VARCHAR(9)), '/2/3/4/5 200 ', CAST(100 + event_id % 900 AS VARCHAR(9)),"
        " ' - - ---- 1/2/3/4/0 0/0 \"GET /p', CAST(event_id % 5 AS VARCHAR(9)), ' HTTP/1.1\"')"
    )


def captive_text() -> str:
    return text(
        f"concat('LAN: zone1 - ACCEPT: ', {USER}, ', ', {MAC}, ', ', {SOURCE_IP})"
    )


TEXTS = {
    "filterlog": filterlog_text, "unbound": unbound_text, "sshd": sshd_text, "php-fpm": portal_text,
    "sshguard": sshguard_text, "kea-dhcp4": kea_text, "suricata": fast_text, "snort": snort_text,
    "(squid-1)": squid_text, "nginx": nginx_text, "haproxy": haproxy_text, "captiveportal": captive_text,
    "dpinger": sshd_text, "ntpd": sshd_text, "named": sshd_text, "openvpn": sshd_text,
}

# Share of each program in a mixed stream, as upper bounds of event_id % 20.
MIX = (
    (8, "filterlog"), (11, "unbound"), (12, "sshd"), (13, "php-fpm"), (14, "sshguard"), (15, "kea-dhcp4"),
    (16, "snort"), (17, "(squid-1)"), (18, "nginx"), (19, "haproxy"), (20, "dpinger"),
)


def program_lines(spark: SparkSession, sf_dir: str, program: str) -> DataFrame:
    """One syslog line of a program per event."""
    line = f"concat({header(program)}, {TEXTS[program]()})"
    return as_events(events(spark, sf_dir).withColumn("line", F.expr(line)), "line", preset="syslog").drop("stamp")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all programs."""
    cases = " ".join(
        f"WHEN event_id % 20 < {upper} THEN concat({header(program)}, {TEXTS[program]()})"
        for upper, program in MIX
    )
    df = events(spark, sf_dir).withColumn("line", F.expr(f"CASE {cases} END"))
    return as_events(df, "line", preset="syslog").drop("stamp")
