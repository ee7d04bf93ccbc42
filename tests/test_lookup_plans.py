"""Lookups that prune, interval tables against brute force, records by type, streams with versions, written batches."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from checks import lines as L
from logweave import Chain, stage
from logweave.functions.shared import new_folder, shared_folder, shared_table
from logweave.operators import geoip, grok, translate
from logweave.operators.intervals import IntervalTable
from logweave.operators.lookup import Lookup, NetworkTable, geo_table
from logweave.plans import audit, enrich
from logweave.plans.full import Tables, complete_records, full_chain, united
from logweave.sinks import read_routed, write_batch
from logweave.sources import as_events, literal_table, read_logs
from logweave.streaming import VersionedTable, stream_versions


def test_a_lookup_reads_its_key_and_the_row_number(spark):
    """Two groks, a lookup on the first: the second and its source column are pruned, before any size is known."""
    df = spark.range(100).select(F.col("id").alias("event_id"), F.concat(F.lit("a "), "id").alias("a"), F.concat(F.lit("b "), "id").alias("b"))
    table = Lookup(df.select(F.col("a").alias("key"), F.lit("v").alias("value")))
    path = new_folder(spark)
    df.write.parquet(path)
    out = Chain([stage("s", grok("a", "a %{INT:[x]}"), grok("b", "b %{INT:[y]}"), translate("x", "z", table))]).apply(spark.read.parquet(path))
    scan = re.findall(r"ReadSchema: struct<([^>]*)>", out.select("z")._jdf.queryExecution().toString())
    assert scan and all("b:" not in s for s in scan)
    plan = out.select("z")._jdf.queryExecution().optimizedPlan().toString()
    assert [h.split("#")[0] for h in re.findall(r"xxhash64\(([^)]*)\)", plan)] == ["event_id"]


def test_no_join_for_a_dictionary_that_is_not_given(spark):
    df = spark.createDataFrame([("22",), (None,)], "k string")
    out = Chain([stage("s", translate("k", "name", None, "port-%{k}"))]).apply(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == [("22", "port-22"), (None, None)]


def _random_networks(rng: random.Random, n: int):
    out = []
    for i in range(n):
        if rng.random() < 0.6:
            base, prefix = rng.choice([0x0A000000, 0x0A010000, 0xC0A80000]) + rng.randrange(1 << 12), rng.choice([0, 5, 8, 15, 16, 20, 23, 24, 27, 30, 31, 32])
            out.append((f"{ipaddress.IPv4Address(base)}/{prefix}", f"n{i}"))
        else:
            base, prefix = (0x20010DB8 << 96) + (rng.randrange(4) << 80) + rng.randrange(1 << 12), rng.choice([3, 16, 32, 33, 47, 48, 49, 64, 100, 116, 120, 127, 128])
            out.append((f"{ipaddress.IPv6Address(base)}/{prefix}", f"n{i}"))
    return out


@pytest.mark.parametrize(("seed", "page"), [(1, 1), (2, 3), (3, 256)])
def test_intervals_against_brute_force(spark, seed, page):
    rng = random.Random(seed)
    one, two = _random_networks(rng, 60), _random_networks(rng, 25)
    if seed == 1:
        one = [n for n in one if not n[0].endswith(("/0", "/3"))]
    addresses = []
    for text, _ in one + two:
        net = ipaddress.ip_network(text, strict=False)
        for a in (net[0], net[-1], net[0] - 1 if int(net[0]) else net[0], net[-1] + 1 if int(net[-1]) < 2**net.max_prefixlen - 1 else net[-1]):
            addresses.append(str(a))
    addresses += ["0.0.0.0", "255.255.255.255", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "no address", "10.0.5.77", "2001:db8:2::7"]

    def best(nets, a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        found = [(-n.prefixlen, v) for t, v in nets if (n := ipaddress.ip_network(t, strict=False)).version == ip.version and ip in n]
        return min(found)[1] if found else None

    both = IntervalTable(
        NetworkTable(literal_table(spark, one, ["network", "p"])), NetworkTable(literal_table(spark, two, ["network", "q"])), page=page
    )
    df = spark.createDataFrame([(a,) for a in addresses], "ip string").repartition(3)
    out = Chain([stage("s", geoip("ip", both, "g"))]).apply(df)
    got = {r[0]: (r[1], r[2]) for r in out.select("ip", "`g.p`", "`g.q`").collect()}
    assert got == {a: (best(one, a), best(two, a)) for a in addresses}
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 1
    again = IntervalTable.read(both.pages)
    again._page = page
    assert again.attributes == ["p", "q"]


def test_an_empty_interval_table(spark):
    none = IntervalTable(NetworkTable(spark.createDataFrame([], "network string, p string")))
    out = Chain([stage("s", geoip("ip", none, "g"))]).apply(spark.createDataFrame([("10.0.0.1",), (None,)], "ip string"))
    assert [r[1] for r in out.select("ip", "`g.p`").collect()] == [None, None]
    with pytest.raises(ValueError):
        IntervalTable(*[NetworkTable(spark.createDataFrame([], "network string, p string"))] * 2)


def test_places_cost_a_join_for_each_address(spark):
    nets = literal_table(spark, [("20.0.0.0/16", "a"), ("2001:db8::/32", "b")], ["network", "country_name"])
    df = spark.createDataFrame([("20.0.0.1", "2001:db8::1", ["pfelk"])], "`source.ip` string, `destination.ip` string, tags array<string>")
    out = Chain([stage("s", *enrich.places(geo_table(nets), NetworkTable(nets.withColumnRenamed("country_name", "owner"))))]).apply(df)
    row = out.first().asDict()
    assert (row["source.geo.country_name"], row["destination.geo.owner"]) == ("a", "b")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_records_by_type_are_those_of_the_whole_chain(spark):
    """Mixed lines, lines of no type, and lines of two types."""
    sf = "/root/testdata/sf0.001"
    lines = L.mixed_lines(spark, sf).filter("event_id < 60")
    more = as_events(L.events(spark, sf).filter("event_id < 3").withColumn("line", F.expr(f"concat({L.header('sshd')}, 'error: kex reset')")), "line", preset="unbound").drop("stamp")
    none = lines.filter("event_id < 3").withColumn("message", F.concat(F.lit("plain "), "event_id"))
    every = lines.union(more.select(lines.columns)).union(none)
    names = ["event_id", "tags", "event.original", "event.dataset", "data_stream.namespace", "source.ip", "client.subdomain", "dns.question.name", "log.syslog.appname", "event.severity"]
    tables = Tables(rule_names=Lookup(literal_table(spark, [("1000000101", "first")], ["key", "value"])))
    whole = full_chain(spark, tables).apply(every)
    apart = complete_records(spark, every, tables)
    kinds = dict(whole.dtypes)
    assert all(kinds[n] == k for n, k in apart.dtypes)
    rows = [sorted((str(tuple(r)) for r in df.select(*(f"`{n}`" for n in names)).collect())) for df in (whole, apart)]
    assert rows[0] == rows[1] and len(rows[0]) == 66
    fixed = complete_records(spark, none, tables, columns={"event.original": "string", "source.ip": "string"})
    assert fixed.columns == ["event.original", "source.ip"] and fixed.count() == 3


def test_united_takes_the_common_type(spark):
    a = spark.createDataFrame([(1, "x")], "n long, t string")
    b = spark.createDataFrame([("q", ["y", "z"], 1.5)], "n string, t array<string>, d double")
    assert sorted(map(tuple, united([a, b]).collect()), key=str) == [("1", ["x"], None), ("q", ["y", "z"], 1.5)]


def test_one_plan_for_each_version(spark, tmp_path):
    for i in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part{i}.txt").write_text(f"k{i}\nboth\n")
    version, built, batches = [0], [], []
    table = VersionedTable(lambda: version[0], lambda: Lookup(literal_table(spark, [("both", f"v{version[0]}")], ["key", "value"])))

    def chain():
        built.append(version[0])
        return Chain([stage("s", translate("message", "t", table.current(), "none"))])

    def write(batch, batch_id):
        batches.append(sorted(r.t for r in batch.select("t").collect()))
        version[0] = 1 if batch_id >= 1 else 0

    plans = stream_versions(
        lambda: read_logs(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger=1), chain, write, str(tmp_path / "cp"), [table], available_now=True
    )
    assert plans == 2 and built == [0, 1]
    assert batches == [["none", "v0"], ["none", "v0"], ["none", "v1"], ["none", "v1"]]

    def fails(batch, batch_id):
        raise RuntimeError("not ours")

    (tmp_path / "in" / "late.txt").write_text("x\n")
    with pytest.raises(Exception, match="not ours"):
        stream_versions(lambda: read_logs(spark, str(tmp_path / "in"), stream=True), chain, fails, str(tmp_path / "cp"), [table], available_now=True)


def test_a_batch_replaces_its_earlier_try(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([(n, d, "ns") for n, d in pairs], "n int, `data_stream.dataset` string, `data_stream.namespace` string")

    path = str(tmp_path / "out")
    write_batch(rows((1, "a"), (2, "gone")), path, 0)
    write_batch(rows((3, "a")), path, 1)
    write_batch(rows((1, "a"), (4, None)), path, 0)
    got = sorted((r.n, r.stream_dataset, r.batch) for r in read_routed(spark, path).collect())
    assert got == [(1, "a", 0), (3, "a", 1), (4, "pfelk.unknown", 0)]
    assert read_routed(spark, path, dataset="a").count() == 2


def test_nested_diff(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":1}},"x":[1]}', '{"a":{"b":{"c":2},"n":null},"x":[1,2],"e":{}}'), (None, '{"a":1}'), ("{}", "{}"), ('"text"', "3")], "o string, n string")
    both = df.select(F.try_parse_json("o").alias("o"), F.try_parse_json("n").alias("n"))
    got = [tuple(r[0]) for r in both.select(audit.nested_diff(F.col("o"), F.col("n"), "v")).collect()]
    assert got[0] == (["v.a.n", "v.e"], ["v.a.b.c", "v.x"], [])
    assert got[1] == (["v.a"], [], []) and got[2] == ([], [], []) and got[3] == ([], ["v"], [])
    shallow = both.limit(1).select(audit.nested_diff(F.col("o"), F.col("n"), "v", depth=1).alias("d")).first().d
    assert shallow.modified == ["v.a", "v.x"] and shallow.added == ["v.e"]


def test_shared_tables(spark):
    assert shared_table(spark.range(3)).count() == 3
    assert new_folder(spark).startswith(shared_folder(spark)) and new_folder(spark) != new_folder(spark)
