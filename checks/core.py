"""Queries for sources, conditions, extraction, mutation and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.registry import query, table
from logweave import Chain, EventFrame, branch, drop, stage
from logweave import predicates as P
from logweave.operators import (
    cidr, csv, date, dissect, dns, geoip, grok, interface_alias, json, kv, mutate, translate,
    url_parts, user_agent_length,
)
from logweave.operators.lookup import Lookup, NetworkTable, geo_table
from logweave.paths import quoted
from logweave.plans.cleanup import normalize_lists, sequence_range
from logweave.plans.dns_server import registered_domain
from logweave.sources import (
    as_events, candidate_lines, candidate_payloads, detect_log_type, literal_table, merge_seed,
    split_messages,
)


def pick(df: DataFrame, *names: str, absent: tuple[str, ...] = (), **renamed: str) -> DataFrame:
    """Columns by path; tags and other arrays joined by commas; extra names as keywords.

    A column that is not there is an error, unless ``absent`` names it: that one must not be there, and reads as NULL.
    """
    types = dict(df.dtypes)

    def column(path: str):
        if (path in types) == (path in absent):
            raise KeyError(f"column {path} is {'there' if path in types else 'not there'}")
        if path in absent:
            return F.lit(None).cast("string")
        c = F.col(quoted(path))
        return F.array_join(c, ",") if types[path].startswith("array<") else c

    return df.select(
        *[column(n).alias(n.replace(".", "_").replace("@", "")) for n in names],
        *[column(path).alias(name) for name, path in renamed.items()],
    )


def run(df: DataFrame, *operators) -> DataFrame:
    return Chain([stage("check", *operators)]).apply(df)


# ---- sources -----------------------------------------------------------------------------

EXTRA = f"concat('<134>1 ', strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ', {L.HOST}, ' sshd ', CAST(event_id AS VARCHAR(9)), ' - - ')"
SSHD = (
    "CASE WHEN event_id % 3 = 0 THEN concat('error: PAM: Authentication error for ', "
    f"{L.USER}, ' from ', {L.SOURCE_IP}) WHEN event_id % 3 = 1 THEN concat('Accepted publickey for ',"
    f" {L.USER}, ' from ', {L.SOURCE_IP}, ' port 22 ssh2') ELSE 'error: kex reset' END"
)
LINE = f"concat({EXTRA}, {SSHD})"


@query("source_lines", f"""
    SELECT event_id, {LINE} AS message, 'syslog' AS type, 'pfelk,firewall_raw' AS tags FROM events""")
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pick(L.program_lines(spark, sf, "sshd"), "event_id", "message", "type", "tags")


@query("source_seed", """
    SELECT event_id, concat('m', CAST(event_id AS VARCHAR)) AS message, 'seeded' AS type, 'a' AS source_zone,
      CASE WHEN event_type = 'error' THEN 'seed-host' ELSE concat('h', CAST(user_id AS VARCHAR)) END AS host_name
    FROM events""")
def source_seed(spark: SparkSession, sf: str) -> DataFrame:
    df = as_events(table(spark, sf, "events"), F.concat(F.lit("m"), F.col("event_id")))
    df = df.withColumn("host.name", F.concat(F.lit("h"), F.col("user_id"))).withColumn(
        "seed.host.name", F.when(F.col("event_type") == "error", "seed-host")
    )
    seeded = merge_seed(df, {"type": "seeded", "message": "ignored", "source": {"zone": "a"}})
    return pick(seeded, "event_id", "message", "type", "source.zone", "host.name")


def _payload(sql_line: str) -> str:
    second = sql_line.replace("<134>", "<135>")
    return (
        f"CASE WHEN event_id % 3 = 0 THEN concat('junk', {sql_line}, chr(10), {second})"
        f" WHEN event_id % 3 = 1 THEN concat('<1>first', chr(10), ' ', chr(10), '<2>second') ELSE 'plain text' END"
    )


@query("source_split_messages", f"""
    SELECT event_id, 0 AS message_index, CASE WHEN event_id % 3 = 0 THEN {LINE} WHEN event_id % 3 = 1 THEN '<1>first'
      ELSE 'plain text' END AS message FROM events
    UNION ALL
    SELECT event_id, 1, CASE WHEN event_id % 3 = 0 THEN {LINE.replace('<134>', '<135>')} ELSE '<2>second' END
    FROM events WHERE event_id % 3 < 2""")
def source_split_messages(spark: SparkSession, sf: str) -> DataFrame:
    line = f"concat({L.header('sshd')}, {L.sshd_text()})"
    df = L.events(spark, sf).select("event_id", F.expr(_payload(line)).alias("payload"))
    return split_messages(df)


_PAYLOADS = """CASE WHEN event_id % 6 = 0 THEN ' <13>line one ' WHEN event_id % 6 = 1 THEN 'short<'
    WHEN event_id % 6 = 2 THEN 'host openvpn started' WHEN event_id % 6 = 3 THEN 'nothing to see here'
    WHEN event_id % 6 = 4 THEN 'late priority <13> here' ELSE concat('<1>a', chr(10), ' <2>b ', chr(10), 'c') END"""


@query("source_candidate_payloads", """
    SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '<13>line one' WHEN event_id % 6 = 2 THEN 'host openvpn started'
      ELSE concat('<1>a', chr(10), ' <2>b ', chr(10), 'c') END AS payload
    FROM events WHERE event_id % 6 IN (0, 2, 5)""")
def source_candidate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr(_PAYLOADS).alias("payload"))
    return candidate_payloads(df)


@query("audit_candidate_count", "SELECT count(*) AS candidates FROM events WHERE event_id % 6 IN (0, 2, 5)")
def audit_candidate_count(spark: SparkSession, sf: str) -> DataFrame:
    from logweave.plans.audit import candidate_count

    return candidate_count(source_candidate_payloads(spark, sf))


@query("source_candidate_lines", """
    SELECT event_id, p AS payload FROM (
      SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '<13>line one' WHEN event_id % 6 = 1 THEN 'short<' ELSE '<1>a' END AS p
      FROM events WHERE event_id % 6 IN (0, 1, 5)
      UNION ALL SELECT event_id, '<2>b' FROM events WHERE event_id % 6 = 5)""")
def source_candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr(_PAYLOADS).alias("payload"))
    return candidate_lines(df)


_KINDS = (
    ("filterlog", "pfSense Firewall (syslog)", "syslog"), ("dhcpd", "pfSense DHCP", "syslog"),
    ("unbound", "Unbound DNS", "unbound"), ("suricata", "Suricata IDS", "suricata"),
    ("haproxy", "HAProxy", "syslog"), ("nginx", "NGINX", "syslog"), ("openvpn", "OpenVPN", "syslog"),
    ("squid", "Squid Proxy", "syslog"),
)
_PREFIX = "CASE " + " ".join(
    f"WHEN doc_id % 11 = {i} THEN '{w.upper() if i % 2 else w} '" for i, (w, _, _) in enumerate(_KINDS)
) + " WHEN doc_id % 11 = 8 THEN '<13>' WHEN doc_id % 11 = 9 THEN '{ \"event_type\": 1 ' ELSE '' END"


def _detect(column: int, generic: str, unknown: str) -> str:
    cases = []
    for kind in _KINDS:
        test = f"contains(lower(t), '{kind[0]}')"
        if kind[0] == "suricata":
            test += r""" OR regexp_matches(t, '(?i)^\s*\{[^\n]*"event_type"')"""
        cases.append(f"WHEN {test} THEN '{kind[column]}'")
    return f"CASE WHEN t = '' THEN NULL {' '.join(cases)} WHEN regexp_matches(t, '^<[0-9]+>') THEN '{generic}' ELSE '{unknown}' END"


@query("source_detect_type", f"""
    SELECT doc_id, {_detect(1, 'Generic Syslog', 'Unknown (auto-parse)')} AS name, {_detect(2, 'syslog', 'syslog')} AS type
    FROM (SELECT doc_id, concat({_PREFIX}, text) AS t FROM documents)""")
def source_detect_type(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", F.concat(F.expr(_PREFIX), "text").alias("t"))
    found = detect_log_type(F.col("t"))
    return df.select("doc_id", found["name"].alias("name"), found["type"].alias("type"))


# ---- conditions and control flow ---------------------------------------------------------


@query("condition_truth", """
    SELECT o_orderkey,
      (p IS NOT NULL) AS p_exists, (p IS NULL) AS p_missing, coalesce(p = '1-URGENT', false) AS p_eq,
      coalesce(p <> '1-URGENT', true) AS p_ne, coalesce(contains(p, 'HI'), false) AS p_match,
      NOT coalesce(regexp_matches(p, '^[0-9]-H'), false) AS p_nomatch,
      coalesce(contains(p, 'LOW'), false) AS p_text, coalesce(p IN ('2-HIGH', '5-LOW'), false) AS p_in,
      (o_orderkey % 2 = 0) AS t_has, (o_orderkey % 2 <> 0) AS t_lacks,
      (o_totalprice > 100000) AS n_gt, (o_totalprice < 100000) AS n_lt, (o_custkey >= 500) AS n_ge, (o_custkey <= 500) AS n_le,
      coalesce(p = '2-HIGH', false) AND o_totalprice > 100000 AS both, coalesce(p = '2-HIGH', false) OR o_totalprice > 400000 AS any
    FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)""")
def condition_truth(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn(
        "p", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END")
    ).withColumn("tags", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('x', 'y') ELSE array('z') END"))
    tests = {
        "p_exists": P.exists("p"), "p_missing": P.missing("p"), "p_eq": P.eq("p", "1-URGENT"),
        "p_ne": P.ne("p", "1-URGENT"), "p_match": P.matches("p", "HI"), "p_nomatch": P.not_matches("p", "^[0-9]-H"),
        "p_text": P.contains_text("p", "LOW"), "p_in": P.one_of("p", ["2-HIGH", "5-LOW"]),
        "t_has": P.has("y"), "t_lacks": P.lacks("x"), "n_gt": P.gt("o_totalprice", 100000),
        "n_lt": P.lt("o_totalprice", 100000), "n_ge": P.ge("o_custkey", 500), "n_le": P.le("o_custkey", 500),
        "both": P.eq("p", "2-HIGH") & P.gt("o_totalprice", 100000),
        "any": P.eq("p", "2-HIGH") | P.gt("o_totalprice", 400000),
    }
    f = EventFrame(df)
    built = {name: test.build(f) for name, test in tests.items()}
    return f.to_df(built).select("o_orderkey", *tests)


@query("flow_branches", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'even click'
        WHEN event_type = 'click' THEN 'odd click' ELSE 'other' END AS label,
      CASE WHEN event_type = 'error' THEN 'rewritten' ELSE event_type END AS event_type,
      CASE WHEN event_type = 'error' THEN 'bad!' ELSE NULL END AS seen FROM events""")
def flow_branches(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("parity", F.expr("CAST(event_id % 2 AS STRING)"))
    out = run(
        df,
        branch(
            (P.eq("event_type", "error"), [
                mutate(replace={"event_type": "rewritten", "label": "bad"}), mutate(add_field={"seen": "%{label}!"})
            ]),
            (P.eq("event_type", "click"), [
                branch((P.eq("parity", "0"), [mutate(replace={"label": "even click"})]),
                       otherwise=[mutate(replace={"label": "odd click"})]),
            ]),
            otherwise=[mutate(replace={"label": "other"})],
        ),
    )
    return pick(out, "event_id", "label", "event_type", "seen")


@query("flow_drop", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
def flow_drop(spark: SparkSession, sf: str) -> DataFrame:
    out = run(table(spark, sf, "events"), branch((P.one_of("event_type", ["error", "view"]), [drop()])))
    return pick(out, "event_id", "event_type")


@query("flow_failures", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'kept' ELSE NULL END AS body_ok,
      CASE WHEN event_id % 3 = 0 THEN '_grokparsefailure' ELSE '' END AS tags FROM events""")
def flow_failures(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN '{\"ok\": \"kept\"}' ELSE '{broken' END").alias("text"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'no digits' ELSE 'n 7' END").alias("line"),
    )
    out = run(df, json("text", target="body"), grok("line", "n %{INT:n}"), mutate(add_field={"body_ok": "%{[body][ok]}"}))
    return pick(out, "event_id", "body_ok", "tags").withColumns(
        {"body_ok": F.nullif("body_ok", F.lit("")), "tags": F.coalesce("tags", F.lit(""))}
    )


# ---- extraction --------------------------------------------------------------------------


@query("grok_header", f"""
    SELECT event_id, '134' AS priority, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, {L.HOST} AS host, CAST(event_id AS VARCHAR) AS procid,
      {SSHD} AS body FROM events""")
def grok_header(spark: SparkSession, sf: str) -> DataFrame:
    from logweave.plans.unwrap import FIREWALL_HEADER

    out = run(L.program_lines(spark, sf, "sshd"), grok("message", FIREWALL_HEADER))
    return pick(out, "event_id", priority="log.syslog.priority", stamp="log.syslog.timestamp",
                host="log.syslog.hostname", procid="log.syslog.procid", body="filter_message")


@query("grok_alternatives", f"""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {L.USER} END AS who, CASE WHEN event_id % 3 = 1 THEN event_id END AS n,
      CASE WHEN event_id % 3 = 2 THEN 'nomatch' ELSE 'hit' END AS tags FROM events""")
def grok_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    text = L.text(f"CASE WHEN event_id % 3 = 0 THEN concat('user=', {L.USER}) WHEN event_id % 3 = 1"
                  " THEN concat('count: ', CAST(event_id AS VARCHAR(9))) ELSE '???' END")
    df = L.events(spark, sf).select("event_id", F.expr(text).alias("message"))
    out = run(df, grok("message", ["user=%{WHO:[who]}", r"count: %{INT:n:int}"], add_tag="hit",
                       tag_on_failure="nomatch", definitions={"WHO": r"[a-z]+\d+"}))
    return pick(out, "event_id", "who", "n", "tags")


@query("json_target", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'parsed' AS tags FROM events")
def json_target(spark: SparkSession, sf: str) -> DataFrame:
    out = run(table(spark, sf, "events").select("event_id", "props"), json("props", target="[data]", add_tag="parsed"),
              mutate(add_field={"k": "%{[data][k]}"}))
    return pick(out, "event_id", "k", "tags")


@query("json_root", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_root(spark: SparkSession, sf: str) -> DataFrame:
    out = run(table(spark, sf, "events").select("event_id", "props"), json("props", fields={"k": "bigint"}))
    return pick(out, "event_id", "k")


@query("csv_columns", """
    SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, ', Inc') ELSE c_mktsegment END AS segment,
      CAST(c_nationkey AS VARCHAR) AS nation, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ' a "b" ' WHEN 3 THEN ' a' END AS note,
      CASE c_custkey % 5 WHEN 4 THEN NULL ELSE '' END AS blank FROM customer""")
def csv_columns(spark: SparkSession, sf: str) -> DataFrame:
    text = ("concat(c_name, ',', CASE WHEN c_custkey % 2 = 0 THEN concat('\"', c_mktsegment, ', Inc\"') ELSE c_mktsegment END,"
            " ',', c_nationkey, CASE c_custkey % 5 WHEN 0 THEN ',,' WHEN 1 THEN ',\"\",' WHEN 2 THEN ',\" a \"\"b\"\" \",' WHEN 3 THEN ', a,' ELSE '' END)")
    df = table(spark, sf, "customer").select("c_custkey", F.expr(text).alias("line"))
    return pick(run(df, csv("line", ["name", "segment", "nation", "note", "blank"])), "c_custkey", "name", "segment", "nation", "note", "blank")


@query("dissect_line", """
    SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, concat('key ', CAST(o_custkey AS VARCHAR), ': x') AS rest FROM orders""")
def dissect_line(spark: SparkSession, sf: str) -> DataFrame:
    text = "concat('[', o_orderstatus, '] skip (', o_orderpriority, ') key ', o_custkey, ': x')"
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("line"))
    return pick(run(df, dissect("line", "[%{status}] %{} (%{[order][priority]}) %{rest}")),
                "o_orderkey", "status", "rest", priority="order.priority")


@query("kv_pairs", """
    SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey + 1 AS VARCHAR) AS cust FROM orders""")
def kv_pairs(spark: SparkSession, sf: str) -> DataFrame:
    text = "concat('status=', o_orderstatus, ' noise cust=', o_custkey, ' cust=', o_custkey + 1)"
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("line"))
    return pick(run(df, kv("line", ["status", "cust"], target="kv")), "o_orderkey", status="kv.status", cust="kv.cust")


@query("date_modes", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS unix,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS unix_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
      concat('2024', strftime(ts, '-%m-%d %H:%M:%S')) AS syslog,
      CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS half FROM events""")
def date_modes(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"),
        F.expr("CAST(unix_timestamp(date_trunc('SECOND', CAST(ts AS TIMESTAMP))) AS STRING)").alias("b"),
        F.expr("CAST(unix_timestamp(date_trunc('SECOND', CAST(ts AS TIMESTAMP))) * 1000 AS STRING)").alias("c"),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss").alias("d"),
        F.date_format("ts", "MMM d HH:mm:ss").alias("e"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE 'not a time' END").alias("g"),
    )
    out = run(df, date("a", "ISO8601", "iso"), date("b", "UNIX", "unix"), date("c", "UNIX_MS", "unix_ms"),
              date("d", "%d/%b/%Y:%H:%M:%S", "text"), date("e", "%b %d %H:%M:%S", "syslog", year=2024),
              date("g", "%Y-%m-%d %H:%M:%S", "half"))
    names = ["iso", "unix", "unix_ms", "text", "syslog", "half"]
    return out.select("event_id", *[F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names])


@query("url_fields", """
    SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS url_scheme,
      nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS url_query,
      nullif(regexp_extract(regexp_replace(url, '[?#].*', ''), '//[^/]*/.*[^/.][^/.]*\\.([^./]+)$', 1), '') AS url_extension,
      length(url) AS total_length,
      len(string_split(regexp_replace(url, '/+$', ''), '/')) - 1 AS total_paths, false AS has_non_ascii, false AS has_whitespace
    FROM pages""")
def url_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages").select("page_id", F.col("url").alias("url.original"))
    out = run(df, url_parts())
    return pick(out, "page_id", "url.scheme", "url.query", "url.extension", total_length="url.meta.total_length",
                total_paths="url.meta.total_paths", has_non_ascii="url.meta.has_non_ascii",
                has_whitespace="url.meta.has_whitespace")


@query("url_credentials", """
    SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN concat('u', CAST(page_id AS VARCHAR)) END AS client_user_name,
      CASE WHEN page_id % 3 = 1 THEN 's3' END AS client_user_password, CASE WHEN page_id % 3 <> 2 THEN CAST(8000 + page_id AS VARCHAR) END AS url_port,
      CASE WHEN page_id % 3 = 2 THEN 'invalid url' END AS tags FROM pages""")
def url_credentials(spark: SparkSession, sf: str) -> DataFrame:
    text = """CASE WHEN page_id % 3 = 0 THEN concat('http://u', page_id, '@h.example:', 8000 + page_id, '/a')
      WHEN page_id % 3 = 1 THEN concat('http://u', page_id, ':s3@h.example:', 8000 + page_id, '/a')
      ELSE 'http://h.example:port/a' END"""
    df = table(spark, sf, "pages").select("page_id", F.expr(text).alias("url.original"))
    out = run(df, url_parts(keep_password=True))
    return pick(out, "page_id", "client.user.name", "client.user.password", "url.port", "tags")


@query("user_agent_length", "SELECT doc_id, length(text) AS n FROM documents")
def user_agent_lengths(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("user_agent.original"))
    return pick(run(df, user_agent_length()), "doc_id", n="user_agent.meta.total_length")


@query("sequence_ranges", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id END AS first, CASE WHEN event_id % 3 = 0 THEN event_id + 9 END AS last
    FROM events""")
def sequence_ranges(spark: SparkSession, sf: str) -> DataFrame:
    text = "CASE WHEN event_id % 3 = 0 THEN concat(event_id, ':', event_id + 9) WHEN event_id % 3 = 1 THEN concat(event_id, 'x') ELSE '' END"
    df = table(spark, sf, "events").select("event_id", F.expr(text).alias("pf.tcp.sequence_number"))
    return pick(run(df, sequence_range()), "event_id", first="pf.tcp.sequence_number", last="pf.tcp.sequence_number_range_end")


@query("registered_domains", """
    SELECT event_id, concat('site', CAST(event_id % 50 AS VARCHAR), '.example') AS domain, 'example' AS tld FROM events""")
def registered_domains(spark: SparkSession, sf: str) -> DataFrame:
    name = L.text(f"concat(CASE WHEN event_id % 2 = 0 THEN {L.DOMAIN} ELSE concat('a.', {L.DOMAIN}) END, CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END)")
    df = table(spark, sf, "events").select("event_id", F.expr(name).alias("dns.question.name"))
    return pick(run(df, *registered_domain()), "event_id", domain="dns.question.registered_domain", tld="dns.question.top_level_domain")


# ---- mutations ---------------------------------------------------------------------------


@query("mutate_fields", """
    SELECT p_partkey, concat('<', p_name, '/', p_brand, '/>') AS added, 'new' AS created,
      CASE WHEN p_partkey % 2 = 0 THEN 'updated' END AS updated, p_name AS renamed, p_brand AS p_brand, p_brand AS copied,
      CAST(NULL AS VARCHAR) AS p_name, CAST(NULL AS VARCHAR) AS p_type FROM part""")
def mutate_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                         F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'old' END").alias("updated"))
    out = run(df, mutate(
        add_field={"added": "<%{p_name}/%{[p_brand]}/%{nothing}>"}, replace={"created": "new"},
        update={"updated": "updated", "absent": "x"}, rename={"p_name": "renamed"}, remove_field="p_type",
        copy={"p_brand": "copied"},
    ))
    return pick(out, "p_partkey", "added", "created", "updated", "renamed", "p_brand", "copied", "p_name", "p_type", absent=("p_name", "p_type"))


@query("mutate_text", """
    SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, p_name AS stripped,
      regexp_replace(p_brand, '([A-Z])rand#([0-9])', '\\1-\\2$', 'g') AS subbed FROM part""")
def mutate_text(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("low"), F.col("p_name").alias("up"),
                                         F.expr("concat(chr(9), ' ', p_name, chr(10))").alias("stripped"), F.col("p_brand").alias("subbed"))
    return pick(run(df, mutate(lowercase="low", uppercase=["up"], strip="stripped",
                               gsub=[("subbed", "([A-Z])rand#([0-9])", r"\1-\2$")])), "p_partkey", "low", "up", "stripped", "subbed")


@query("mutate_tags", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a,a,b,c' ELSE 'a,a,b' END AS t1, CASE WHEN p_partkey % 2 = 0 THEN 'b,c' ELSE 'b' END AS t2 FROM part""")
def mutate_tags(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", F.expr("CAST(p_partkey % 2 AS STRING)").alias("odd"), F.expr("array('a', 'a')").alias("tags"))
    first = run(df, mutate(add_tag=["a", "b"]), branch((P.eq("odd", "0"), [mutate(add_tag="c")])))
    second = run(first.withColumn("t1", F.array_join("tags", ",")), mutate(remove_tag="a"))
    return pick(second, "p_partkey", "t1", t2="tags")


@query("mutate_convert", """
    SELECT o_orderkey, o_custkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS maybe,
      CASE WHEN o_orderkey % 3 <> 0 THEN 'n/a' END AS maybe_raw, o_orderstatus = 'O' AS flag, CAST(o_custkey AS VARCHAR) AS s FROM orders""")
def mutate_convert(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CAST(o_custkey AS STRING)").alias("i"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'n/a' END").alias("maybe"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 'On' ELSE 'no' END").alias("flag"), F.col("o_custkey").alias("s"))
    return pick(run(df, mutate(convert={"i": "integer", "maybe": "integer", "flag": "boolean", "s": "string"})),
                "o_orderkey", "i", "maybe", "maybe_raw", "flag", "s")


@query("mutate_split_join", """
    SELECT p_partkey, replace(p_name, ' ', '+') AS joined, string_split(p_name, ' ')[2] AS second, concat(replace(p_name, ' ', ','), ',x,x') AS merged FROM part""")
def mutate_split_join(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("words"), F.col("p_name").alias("joined"),
                                         F.col("p_name").alias("merged"), F.expr("array('x', 'x')").alias("more"))
    out = run(df, mutate(split={"words": " ", "joined": " ", "merged": " "}), mutate(join={"joined": "+"}, merge={"merged": "more"}),
              mutate(add_field={"second": "%{[words][1]}"}))
    return pick(out, "p_partkey", "joined", "second", "merged")


@query("normalize_lists", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'firewall' END AS dataset FROM events""")
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr(
        "CASE WHEN event_id % 3 = 0 THEN array('', 'firewall', event_type, 'last') WHEN event_id % 3 = 1 THEN array(' ', 'firewall')"
        " ELSE array('', NULL) END").alias("event.dataset"))
    return pick(run(df, normalize_lists()), "event_id", dataset="event.dataset")


# ---- lookups -----------------------------------------------------------------------------

_TRANSLATE = """
    SELECT c_custkey, coalesce(n_name, concat('Nation ', CAST(c_custkey % 40 AS VARCHAR), ' %{absent}')) AS nation,
      coalesce(n_name, 'before') AS kept
    FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40"""


def _translate(spark: SparkSession, sf: str, **options) -> DataFrame:
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    df = table(spark, sf, "customer").select("c_custkey", F.expr("CAST(c_custkey % 40 AS STRING)").alias("code"), F.lit("before").alias("kept"))
    known = Lookup(names, **options)
    return pick(run(df, translate("code", "nation", known, "Nation %{code} %{absent}"), translate("code", "kept", known)),
                "c_custkey", "nation", "kept")


@query("lookup_translate", _TRANSLATE)
def lookup_translate(spark: SparkSession, sf: str) -> DataFrame:
    return _translate(spark, sf, size=1 << 20)


@query("lookup_translate_salted", _TRANSLATE)
def lookup_translate_salted(spark: SparkSession, sf: str) -> DataFrame:
    return _translate(spark, sf)


_NETWORKS = """SELECT concat('10.', CAST(n_nationkey AS VARCHAR(9)), '.0.0/16') AS network, n_name AS country_name,
  concat('C', CAST(n_nationkey AS VARCHAR(9))) AS country_code2, CAST(n_nationkey AS DOUBLE) AS latitude FROM nation
  UNION ALL SELECT concat('10.', CAST(n_nationkey AS VARCHAR(9)), '.0.128/25'), concat(n_name, ' near'), NULL, CAST(NULL AS DOUBLE) FROM nation WHERE n_nationkey < 9
  UNION ALL SELECT '10.0.0.0/9', 'WIDE', NULL, CAST(0 AS DOUBLE) FROM region WHERE r_regionkey = 0
  UNION ALL SELECT concat('2001:db8:', CAST(r_regionkey AS VARCHAR(9)), '::/48'), r_name, 'V6', CAST(1 AS DOUBLE) FROM region"""


def networks(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"__net_{name}")
    return spark.sql(L.text(_NETWORKS).replace("FROM nation", "FROM __net_nation").replace("FROM region", "FROM __net_region"))


@query("lookup_geo", """
    WITH e AS (SELECT event_id, user_id % 256 AS b, event_id % 256 AS d, event_id % 5 AS kind, event_id % 7 AS g FROM events)
    SELECT event_id, CASE WHEN kind = 4 THEN r_name WHEN kind < 4 AND n_nationkey < 9 AND d >= 128 THEN concat(n_name, ' near')
        WHEN kind < 4 AND n_nationkey IS NOT NULL THEN n_name WHEN kind < 4 AND b < 128 THEN 'WIDE' END AS country,
      CASE WHEN kind = 4 THEN CASE WHEN r_name IS NOT NULL THEN 'V6' END WHEN n_nationkey < 9 AND d >= 128 THEN NULL WHEN n_nationkey IS NOT NULL THEN concat('C', CAST(n_nationkey AS VARCHAR)) END AS code3,
      CASE WHEN kind = 4 THEN CASE WHEN r_name IS NOT NULL THEN 1.0 END WHEN n_nationkey < 9 AND d >= 128 THEN NULL WHEN n_nationkey IS NOT NULL THEN CAST(n_nationkey AS DOUBLE) WHEN b < 128 THEN 0.0 END AS lat
    FROM e LEFT JOIN nation ON kind < 4 AND n_nationkey = b LEFT JOIN region ON kind = 4 AND r_regionkey = g""")
def lookup_geo(spark: SparkSession, sf: str) -> DataFrame:
    address = L.text(f"CASE WHEN event_id % 5 = 4 THEN concat('2001:DB8:', CAST(event_id % 7 AS VARCHAR(9)), '::', {L.v6_groups('user_id')}) ELSE {L.SOURCE_IP} END")
    df = table(spark, sf, "events").select("event_id", F.expr(address).alias("source.ip"))
    out = run(df, geoip("[source][ip]", geo_table(networks(spark, sf)), "[source][geo]"))
    return pick(out, "event_id", country="source.geo.country_name", code3="source.geo.country_code3", lat="source.geo.location.lat")


@query("lookup_cidr", """
    SELECT event_id, CASE WHEN b IN (10, 127) OR (b = 172 AND c BETWEEN 16 AND 31) OR (b = 192 AND c = 168) OR (b = 169 AND c = 254) OR b BETWEEN 224 AND 239
      THEN 'private' ELSE '' END AS tags FROM (SELECT event_id, user_id % 256 AS b, CASE WHEN event_id % 3 = 0 THEN 168 WHEN event_id % 3 = 1 THEN 20 ELSE 254 END AS c FROM events)""")
def lookup_cidr(spark: SparkSession, sf: str) -> DataFrame:
    from logweave.functions.ip import PRIVATE_NETWORKS

    text = "concat(user_id % 256, '.', CASE WHEN event_id % 3 = 0 THEN 168 WHEN event_id % 3 = 1 THEN 20 ELSE 254 END, '.1.', event_id % 256)"
    df = table(spark, sf, "events").select("event_id", F.expr(text).alias("ip"))
    out = run(df, cidr("ip", [*PRIVATE_NETWORKS, "not a network"], "private"))
    return pick(out, "event_id", "tags").withColumn("tags", F.coalesce("tags", F.lit("")))


@query("lookup_cidr_table", """
    SELECT event_id, CASE WHEN user_id % 256 < 128 THEN 'listed' ELSE '' END AS tags FROM events""")
def lookup_cidr_table(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr(L.text(L.SOURCE_IP)).alias("ip"))
    out = run(df, cidr("ip", NetworkTable(networks(spark, sf), attributes=[]), "listed"))
    return pick(out, "event_id", "tags").withColumn("tags", F.coalesce("tags", F.lit("")))


@query("lookup_dns", f"""
    SELECT event_id, coalesce(c_name, ip) AS domain, coalesce(CAST(user_id AS VARCHAR), 'x') AS ip2 FROM
      (SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS ip FROM events) LEFT JOIN customer ON c_custkey = user_id""")
def lookup_dns(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_name").alias("host"))
    df = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("ip"))
    out = run(df, mutate(copy={"ip": "domain"}), dns(Lookup(known, "ip", ["host"]), reverse=["domain"]), mutate(copy={"domain": "back"}),
              dns(addresses=Lookup(known, "host", ["ip"]), resolve=["back"]))
    return pick(out, "event_id", "domain", ip2="back")


@query("lookup_interface", """
    SELECT event_id, CASE WHEN h = 2 THEN NULL WHEN n = 'igb0' THEN concat('A', CAST(h AS VARCHAR)) WHEN n = 'igb1x' OR n = 'igb1y' THEN 'PAT' ELSE n END AS alias,
      CASE WHEN h = 2 THEN NULL WHEN n = 'igb0' THEN 'Net' WHEN n = 'igb1x' OR n = 'igb1y' THEN NULL ELSE n END AS network
    FROM (SELECT event_id, user_id % 3 AS h, CASE WHEN event_id % 4 = 0 THEN 'igb0' WHEN event_id % 4 = 1 THEN 'igb1x' WHEN event_id % 4 = 2 THEN 'igb1y' ELSE 'em0' END AS n FROM events)""")
def lookup_interface(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(f"fw{h}", i, a, n, p) for h in (0, 1) for i, a, n, p in (("igb0", f"A{h}", "Net", None), (None, "PAT", None, "^igb1.$"))]
    known = literal_table(spark, rows, ["hostname", "interface", "alias", "network", "pattern"])
    name = "CASE WHEN event_id % 4 = 0 THEN 'igb0' WHEN event_id % 4 = 1 THEN 'igb1x' WHEN event_id % 4 = 2 THEN 'igb1y' ELSE 'em0' END"
    df = table(spark, sf, "events").select("event_id", F.expr(L.text(L.HOST)).alias("log.syslog.hostname"), F.expr(name).alias("interface.name"))
    return pick(run(df, interface_alias(known)), "event_id", alias="interface.alias", network="network.name")
