"""Sample lines through the whole chain, streams, sinks, and audit."""

import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logweave import Chain, drop, branch, stage
from logweave import predicates as P
from logweave.operators import grok, json, mutate
from logweave.operators.lookup import Lookup
from logweave.pipeline import dispatch
from logweave.plans import apps, cleanup, dns_server, firewall, unwrap
from logweave.plans.sample import sample_chain
from logweave.sinks import export_json, write_routed
from logweave.sources import as_events, literal_table, read_logs
from logweave.streaming import RefreshingTable, checkpoint_location, stream_chain

# Lines in the declared formats; names and addresses are those kept for documentation.
LINES = {
    "filterlog": "<134>1 2025-03-08T19:01:12.000300-03:00 gate.example.net filterlog 640 - - 5,,,1000000103,igb0,match,block,in,4,0x0,,64,0,0,DF,6,tcp,60,192.0.2.31,203.0.113.53,12345,53,0,S,1234567890,,1024,,mss;sackOK;TS",
    "attack": '1 2025-03-09T08:15:02.250000+02:00 gate.example.net sshguard 811 - - Attack from "198.51.100.7" on service unknown service with danger 10.',
    "blocking": '<38>1 2025-03-09T08:15:04.500000+02:00 gate.example.net sshguard 811 - - Blocking "198.51.100.7/32" for 120 secs (3 attacks in 22 secs, after 1 abuses over 22 secs.)',
    "failure": "<32>1 2025-03-09T08:16:11.125000+02:00 gate.example.net php-fpm 902 - - /index.php: webConfigurator authentication error for user 'carol' from: 198.51.100.7",
    "success": "<32>1 2025-03-09T08:17:30.000001+02:00 gate.example.net php-fpm 902 - - /index.php: webConfigurator login for user 'dave' from: 198.51.100.9",
    "dhcp": "<30>Mar  8 19:02:40 gate dhcpd: DHCPACK on 192.0.2.150 to 02:00:5e:10:00:01 (phone-of-erin) via igb1",
    "dns": "<30>1 2025-03-09T08:16:11.125000+02:00 fw unbound 733 - - [4711:2] info: 198.51.100.22 node.shop.example. AAAA IN NOERROR 0.01 1 100",
}


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """A handful of rows is not worth compiling the chain for."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def small_chain(*cases):
    return Chain([
        stage("unwrap", *unwrap.unwrap()), stage("types", dispatch(*cases)), stage("clean", *cleanup.cleanup())
    ])


@pytest.fixture(scope="module")
def records(spark):
    df = as_events(literal_table(spark, list(LINES.items()), ["name", "message"]), preset="syslog")
    chain = small_chain(
        *firewall.filterlog(), *apps.sshguard(), *apps.web_portal(), *dns_server.unbound()
    )
    return {r["name"]: {k: v for k, v in r.asDict().items() if v is not None} for r in chain.apply(df).collect()}


def test_filterlog(records):
    r = records["filterlog"]
    assert r["event.original"] == LINES["filterlog"] and r["event.dataset"] == "pfelk.firewall"
    assert r["rule.uuid"] == "1000000103" and r["pf.block_reason"] == "New Connection Attempt (Blocked)"
    assert r["tags"] == ["pfelk", "firewall_raw", "firewall", "unauthorized_attempt"]
    assert (r["network.direction"], r["network.type"], r["source.bytes"], r["source.packets"]) == ("ingress", "ipv4", "0", "60")
    assert r["pf.tcp.options"] == ["mss", "sackOK", "TS"] and r["pf.tcp.sequence_number"] == 1234567890
    assert r["destination.port"] == "53" and r["pf.ecn"] == "" and "pf.data_length" not in r
    assert not {"filter_message", "pfelk_csv", "message"} & set(r)


def test_line_without_priority_falls_back(records):
    r = records["attack"]
    assert r["tags"][-1] == "pfelk_routing_fallback" and "grok_fail_00_input_firewall_rfc5424" in r["tags"]


def test_blocking(records):
    r = records["blocking"]
    assert (r["source.ip"], r["sshguard.block_duration"], r["sshguard.attack_count"]) == ("198.51.100.7", 120, "3")
    assert (r["event.action"], r["event.type"]) == ("blocking", "denied")
    assert "blocked_target" not in r


def test_portal(records):
    a, b = records["failure"], records["success"]
    assert (a["event.severity"], a["event.outcome"], a["user.name"], a["url.path"]) == (3, "failure", "carol", "/index.php")
    assert (b["event.severity"], b["event.outcome"], b["pf.app.action"]) == (0, "success", "webconfigurator login")
    assert (a["source.ip"], b["source.ip"]) == ("198.51.100.7", "198.51.100.9")


def test_dns(records):
    r = records["dns"]
    assert (r["dns.question.registered_domain"], r["dns.question.top_level_domain"]) == ("shop.example", "example")
    assert (r["client.ip"], r["dns.return_code"]) == ("198.51.100.22", "NOERROR")


def test_sample_chain(spark):
    vpn = "<134>1 2026-02-12T10:30:45Z fw openvpn 5 - - 192.0.2.77:12345 [client1] Peer up"
    dhcp = "<134>1 2026-02-12T10:30:45Z fw dhcpd 5 - - DHCPACK on 192.0.2.150 to 02:00:5e:10:00:01 (phone) via igb1"
    df = literal_table(spark, [(LINES["filterlog"],), (vpn,), (dhcp,)], ["message"])
    got = {r["event_type"]: r for r in sample_chain().apply(df).collect()}
    assert got["firewall"]["src_port"] == 12345 and got["firewall"]["options"] == "mss;sackOK;TS"
    assert got["vpn"]["vpn_client_name"] == "client1"
    # the word in "DHCP<word>" has to start at a word boundary, so the declared pattern never matches
    assert got["dhcp"]["dhcp_action"] is None and got["dhcp"]["tags"] == ["_grokparsefailure"]


def test_audit_records_each_operator(spark):
    df = literal_table(spark, [("n 5", "{bad"), ("x", '{"a": 1}')], ["m", "j"])
    out = Chain([
        stage("one", grok("m", "n %{INT:[n]}"), json("j", target="[o]")),
        stage("two", branch((P.exists("[n]"), [mutate(convert={"n": "integer"})]))),
    ]).apply(df, audit=True, snapshots=True)
    got = {r.m: r.audit for r in out.collect()}
    assert [a.changes for a in got["n 5"]] == ["Fields Added", "Error", "Fields Modified"]
    assert [a.changes for a in got["x"]] == ["Tags Added", "Fields Added", "No Changes"]
    assert [a.executed for a in got["x"]] == [True, True, False]
    assert got["n 5"][0].before["m"] == "n 5" and got["n 5"][0].after["n"] == "5" and "n" not in got["n 5"][0].before


def test_transform_stage_and_drop(spark):
    df = literal_table(spark, [("a",), ("b",)], ["k"])
    out = Chain([
        stage("drop", branch((P.eq("k", "a"), [drop()]))),
        stage("plain", transform=lambda d: d.withColumn("twice", F.concat("k", "k"))),
        stage("after", mutate(uppercase="twice")),
    ]).apply(df)
    assert [tuple(r) for r in out.collect()] == [("b", "BB")]


def _write_lines(folder):
    folder.mkdir()
    for i in range(3):
        lines = [LINES["filterlog"].replace("12345,53", f"{i}{j},53") for j in range(20)]
        (folder / f"part{i}.log").write_text("\n".join([*lines, LINES["dns"]]))


def test_stream_equals_batch(spark, tmp_path):
    _write_lines(tmp_path / "in")
    chain = small_chain(*firewall.filterlog(), *dns_server.unbound())
    batch = chain.apply(read_logs(spark, str(tmp_path / "in"), preset="syslog"))
    stream = chain.apply(read_logs(spark, str(tmp_path / "in"), preset="syslog", stream=True))
    query = write_routed(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    assert query.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in got.select("event.original").collect()) == sorted(r[0] for r in batch.select("`event.original`").collect())
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{tmp_path}/out/stream_type=logs/*")) == ["pfelk.firewall", "pfelk.unbound"]
    ports = got.filter("stream_dataset = 'pfelk.firewall'").select("source.port").collect()
    assert sorted(r[0] for r in ports) == sorted(f"{i}{j}" for i in range(3) for j in range(20))


def test_refreshed_dictionary_in_stream(spark, tmp_path):
    from logweave.operators import translate

    _write_lines(tmp_path / "in")
    built = []
    table = RefreshingTable(lambda: built.append(1) or Lookup(literal_table(spark, [("x", "y")], ["key", "value"])), 0)
    chain = lambda: Chain([stage("s", translate("type", "t", table.current(), "none"))])
    write = lambda b, i: b.write.mode("overwrite").json(f"{tmp_path}/out/batch={i}")
    stream = read_logs(spark, str(tmp_path / "in"), preset="syslog", stream=True, maxFilesPerTrigger=1)
    query = stream_chain(stream, chain, write, str(tmp_path / "cp"), available_now=True, tables=[table])
    assert query.awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/out").filter("t = 'none'").count() == 63 and len(built) >= 1


def test_checkpoint_folder_comes_from_the_session():
    def session(folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder))

    assert checkpoint_location(session("/shared/cp/"), "s") == "/shared/cp/s"
    with pytest.raises(ValueError):
        checkpoint_location(session(None), "s")


def test_json_export(spark, tmp_path):
    df = literal_table(spark, [("1", "x")], ["a.b", "c"]).withColumn("gone", F.lit(None).cast("string"))
    export_json(df, str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":{"b":"1"},"c":"x"}']
