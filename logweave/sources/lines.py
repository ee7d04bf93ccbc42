"""Line sources, payload splitting and log-type detection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.frame import flatten
from logweave.functions.text import strip
from logweave.paths import quoted
from logweave.plans.fixed import PRODUCT

# Type and tags of the three live inputs.
PRESETS: dict[str, dict[str, Any]] = {
    "suricata": {"type": "suricata", "tags": [PRODUCT, "suricata_json_stream"]},
    "syslog": {"type": "syslog", "tags": [PRODUCT, "firewall_raw"]},
    "unbound": {"type": "unbound", "tags": [PRODUCT, "unbound_raw"]},
}

# Words that mark a payload as a log line.
KEYWORDS = ("filterlog", "dhcpd", "unbound", "suricata", "php-fpm", "openvpn", "sshd")

_MESSAGE_START = r"<\d+>\d+\s+\d{4}-\d{2}-\d{2}T"


def as_events(
    df: DataFrame,
    message: str | Column = "message",
    type: str = "syslog",
    tags: Iterable[str] = (),
    preset: str | None = None,
) -> DataFrame:
    """Any table with a text column as events: ``message``, ``type``, ``tags``, other columns kept."""
    if preset is not None:
        type, tags = PRESETS[preset]["type"], PRESETS[preset]["tags"]
    text = F.col(message) if isinstance(message, str) else message
    kept = [
        F.col(quoted(c))
        for c in df.columns
        if c not in ("message", "type", "tags") and not (isinstance(message, str) and c == message)
    ]
    return df.select(
        *kept,
        text.alias("message"),
        F.lit(type).alias("type"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
    )


def read_logs(
    spark: SparkSession,
    path: str | list[str],
    type: str = "syslog",
    tags: Iterable[str] = (),
    preset: str | None = None,
    stream: bool = False,
    **options: Any,
) -> DataFrame:
    """Text files, one event per line; ``stream=True`` follows a folder as new files arrive."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    return as_events(reader.text(path), "value", type, tags, preset)


def merge_seed(df: DataFrame, seed: Mapping[str, Any] | None = None, prefix: str = "seed") -> DataFrame:
    """Lay seed values over events: a seeded leaf wins, but the message stays.

    The seed is a nested mapping of literals, or columns under ``prefix`` for a seed per row.
    """
    df = flatten(df)
    leaves: dict[str, Column] = {}

    def walk(node: Mapping[str, Any], names: list[str]) -> None:
        for key, value in node.items():
            if isinstance(value, Mapping):
                walk(value, [*names, key])
            elif isinstance(value, list):
                leaves[".".join([*names, key])] = F.array(*[F.lit(v) for v in value])
            else:
                leaves[".".join([*names, key])] = F.lit(value)

    walk(seed or {}, [])
    start = prefix + "."
    for c in df.columns:
        if c.startswith(start):
            leaves[c[len(start):]] = F.col(quoted(c))
    leaves.pop("message", None)
    columns = [c for c in df.columns if not c.startswith(start)]
    out = []
    for c in columns:
        base = F.col(quoted(c))
        out.append(F.coalesce(leaves[c], base).alias(c) if c in leaves else base)
    out += [value.alias(name) for name, value in leaves.items() if name not in columns]
    return df.select(*out)


def messages_of(payload: Column) -> Column:
    """The messages inside one payload.

    Two or more dated syslog headers: cut at each header, text before the first is dropped.
    Else several lines that all hold a priority: one message per line. Else the payload itself.
    """
    pieces = F.filter(
        F.split(payload, f"(?={_MESSAGE_START})"), lambda p: p.rlike(f"^{_MESSAGE_START}")
    )
    lines = F.filter(F.split(payload, "\n"), lambda p: p.rlike(r"\S"))
    return (
        F.when(F.size(pieces) > 1, F.transform(pieces, strip))
        .when((F.size(lines) > 1) & F.forall(lines, lambda p: p.rlike(r"<\d+>")), lines)
        .otherwise(F.array(payload))
    )


def split_messages(df: DataFrame, payload: str = "payload", message: str = "message") -> DataFrame:
    """One row per message of each payload, numbered from 0 in ``message_index``."""
    kept = [F.col(quoted(c)) for c in df.columns if c != payload]
    return df.select(
        *kept, F.posexplode(messages_of(F.col(quoted(payload)))).alias("message_index", message)
    )


def candidate_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that look like log lines, white space trimmed."""
    text = strip(F.col(quoted(payload)))
    start = F.substring(payload, 1, 120)
    keyword = start.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        keyword = keyword | start.contains(word)
    trimmed = df.withColumn(payload, text)
    return trimmed.filter(
        (F.length(payload) >= 10) & (F.substring(payload, 1, 10).contains("<") | keyword)
    )


def candidate_lines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Lines of each payload with ``<`` among their first ten characters, white space trimmed."""
    line = strip(F.col("line"))
    kept = [F.col(quoted(c)) for c in df.columns if c != payload]
    return (
        df.select(*kept, F.explode(F.split(F.col(quoted(payload)), "\n")).alias("line"))
        .withColumn("line", line)
        .filter(F.substring("line", 1, 10).contains("<"))
        .withColumnRenamed("line", payload)
    )


# Name, type, tag and program of each known log, in test order.
_KNOWN_LOGS = (
    ("pfSense Firewall (syslog)", "syslog", "firewall_raw", "filterlog"),
    ("pfSense DHCP", "syslog", "dhcp", "dhcpd"),
    ("Unbound DNS", "unbound", "unbound_raw", "unbound"),
    ("Suricata IDS", "suricata", "suricata_json_stream", "suricata"),
    ("HAProxy", "syslog", "haproxy", "haproxy"),
    ("NGINX", "syslog", "nginx", "nginx"),
    ("OpenVPN", "syslog", "openvpn", "openvpn"),
    ("Squid Proxy", "syslog", "squid", "squid"),
)


def detect_log_type(text: Column) -> Column:
    """Name, type, tags and program guessed from a line; NULL for an empty one."""

    def record(name: str, kind: str, tags: Column, program: str | None) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(kind).alias("type"),
            tags.alias("tags"),
            F.lit(program).cast("string").alias("appname"),
        )

    none = F.lit(None).cast("array<string>")
    lowered = F.lower(text)
    out = F.when(text.isNull() | (text == ""), F.lit(None))
    for name, kind, tag, program in _KNOWN_LOGS:
        test = lowered.contains(program)
        if program == "suricata":
            test = test | text.rlike(r'(?i)^\s*\{.*"event_type"')
        out = out.when(test, record(name, kind, F.array(F.lit(PRODUCT), F.lit(tag)), program))
    out = out.when(text.rlike(r"^<\d+>"), record("Generic Syslog", "syslog", none, None))
    return out.otherwise(record("Unknown (auto-parse)", "syslog", none, None))
