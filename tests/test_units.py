import ipaddress
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave import Chain, branch, stage, to_nested
from logweave import predicates as P
from logweave.functions.ip import in_networks, ip_hex, network_ranges, with_bounds
from logweave.functions.regex import replacement_to_java, to_java
from logweave.operators import cidr, geoip, grok, mutate, translate
from logweave.operators.extract import datetime_pattern
from logweave.operators.grok import SEPARATOR, compile_pattern
from logweave.operators.lookup import Lookup, NetworkTable
from logweave.patterns import library, load_folder
from logweave.sources import literal_table, read_dictionary


def run(df, *operators):
    return Chain([stage("test", *operators)]).apply(df)


def rows(spark, column, values):
    return literal_table(spark, [(v,) for v in values], [column])


ADDRESSES = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "01.2.3.4", "256.1.1.1", "::", "::1", "fe80::1:2", "1::",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3",
    "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "12345::", "g::1", "abc", "", "1:2:3",
    ":1:2:3:4:5:6:7:8", "::256.1.1.1", "1.2.3.4.5", "1:2:3:4::5:6:7:8", ":", ":::", "1:::2", "1.2.3.4::",
]


def test_address_keys(spark):
    got = rows(spark, "ip", ADDRESSES).select("ip", ip_hex(F.col("ip")).alias("key")).collect()
    for ip, key in got:
        try:
            a = ipaddress.ip_address(ip)
            want = f"{int(a):0{8 if a.version == 4 else 32}X}"
        except ValueError:
            want = None
        assert key == want, ip


def test_private_network_edges(spark):
    from logweave.functions.ip import PRIVATE_NETWORKS

    edges = set()
    for text in PRIVATE_NETWORKS:
        net = ipaddress.ip_network(text, strict=False)
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                edges.add(str((ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(n)))
    nets = [ipaddress.ip_network(t, strict=False) for t in PRIVATE_NETWORKS]
    df = rows(spark, "ip", sorted(edges))
    for ip, hit in df.select("ip", in_networks(ip_hex(F.col("ip")), PRIVATE_NETWORKS)).collect():
        a = ipaddress.ip_address(ip)
        assert hit == any(a in n for n in nets if n.version == a.version), ip


def test_network_bounds(spark):
    texts = ["10.0.0.0/8", "0.0.0.0/0", "1.2.3.4", "1.2.3.200/25", "fe80::/10", "::", "2001:db8::/33", "x/8", "1.2.3.4/40"]
    for n, low, high, prefix in with_bounds(rows(spark, "n", texts), "n").select("n", "low", "high", "prefix").collect():
        want = network_ranges([n])
        assert ((low, high) if prefix is not None else None) == (want[0] if want else None), n


@pytest.mark.parametrize("small", [True, False])
def test_longest_prefix_against_brute_force(spark, small):
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.128/25", "10.1.2.130/32", "128.0.0.0/1",
            "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1:2::/64", "2000::/4", "::1"]
    ips = ["10.1.2.130", "10.1.2.131", "10.1.2.1", "10.1.3.1", "10.2.0.1", "9.9.9.9", "200.1.1.1", "2001:db8:1:2::9",
           "2001:db8:1:3::9", "2001:db8:2::9", "2001:db9::1", "::1", "::2", "bad"]
    table = literal_table(spark, [(n, f"n{i}") for i, n in enumerate(nets)], ["network", "city_name"])
    known = NetworkTable(table, size=1 << 20 if small else None)
    out = run(rows(spark, "ip", ips), geoip("ip", known, "geo"))
    for ip, city in out.select("ip", "`geo.city_name`").collect():
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            assert city is None
            continue
        best = max(((ipaddress.ip_network(n).prefixlen, f"n{i}") for i, n in enumerate(nets)
                    if ipaddress.ip_network(n).version == a.version and a in ipaddress.ip_network(n)), default=(0, None))
        assert city == best[1], ip


def test_salted_lookup_keeps_hot_and_missing_keys(spark):
    df = spark.range(3000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id) END").alias("k"))
    table = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value")).union(
        literal_table(spark, [("hot", "fire")], ["key", "value"]))
    table = table.union(table)  # every entry twice
    both = [run(df, translate("k", "v", Lookup(table, size=s), "none")) for s in (None, 1 << 20)]
    assert "BroadcastHashJoin" in both[1]._jdf.queryExecution().executedPlan().toString()
    a, b = (sorted(map(tuple, x.select("id", "v").collect())) for x in both)
    assert a == b and len(a) == 3000


def test_grok_empty_missing_and_separator(spark):
    texts = ["a=1 b=", "a= b=2", f"x{SEPARATOR}a=1{SEPARATOR}2 b=3", "none", ""]
    out = run(rows(spark, "m", texts), grok("m", r"a=(?<a>\S*) b=(?<b>\d)?"))
    got = {r.m: (r.a, r.b, r.tags) for r in out.collect()}
    assert got["a=1 b="] == ("1", None, None)
    assert got["a= b=2"] == ("", "2", None)
    assert got[texts[2]] == (f"1{SEPARATOR}2", "3", None)
    assert got["none"] == (None, None, ["_grokparsefailure"])


def test_every_library_pattern_compiles(spark):
    jvm = spark._jvm.java.util.regex.Pattern
    for name in library():
        jvm.compile(compile_pattern(f"%{{{name}}}").whole)


def test_pattern_folder(tmp_path):
    (tmp_path / "one").write_text("# note\nA x+\n\nB %{A}y\n")
    (tmp_path / "README.md").write_text("C z")
    (tmp_path / ".hidden").write_text("D z")
    assert load_folder(tmp_path) == {"A": "x+", "B": "%{A}y"}


def test_regex_translation(spark):
    assert to_java(r"^{.*}$") == r"^\{.*}$"
    assert to_java(r"[[]a{2}x{,3}") == r"[\[]a{2}x{0,3}"
    assert replacement_to_java(r"\1$") == r"$1\$"
    assert datetime_pattern("%Y%m%d")[0] == "yyyyMMdd"
    assert datetime_pattern("%b %d at")[0] == "MMM d' at'"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab, ;", max_size=8), min_size=1, max_size=12))
def test_split_then_join_is_identity(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = run(df, mutate(split={"t": ","}), mutate(join={"t": ","}))
    assert [r.t for r in out.collect()] == texts


def test_tags_stay_unique_and_ordered(spark):
    df = rows(spark, "k", ["1", "2"]).withColumn("tags", F.when(F.col("k") == "1", F.array(F.lit("z"), F.lit("z"))))
    out = run(
        df, mutate(add_tag=["a", "z"]), branch((P.eq("k", "1"), [mutate(remove_tag="a"), mutate(add_tag="b")])),
        mutate(add_tag="a"), branch((P.has("b"), [mutate(add_field={"seen": "b"})])),
    )
    got = {r.k: (r.tags, r.seen) for r in out.collect()}
    assert got == {"1": (["z", "z", "b", "a"], "b"), "2": (["a", "z"], None)}


def test_scalar_parent_gives_way(spark):
    out = run(rows(spark, "a", ["x"]), mutate(add_field={"[a][b]": "y"}))
    assert out.columns == ["a.b"]
    assert to_nested(out).first().a.b == "y"
    renamed = run(rows(spark, "os", ["x"]), mutate(rename={"[os]": "[os][full]"}))
    assert renamed.columns == ["os.full"] and renamed.first()[0] == "x"


def test_rename_moves_subtree_in_block(spark):
    df = rows(spark, "k", ["1", "2"]).withColumn("s.a", F.lit("A")).withColumn("s.b.c", F.lit("C"))
    out = run(df, branch((P.eq("k", "1"), [mutate(rename={"[s]": "[t]"})])))
    got = {r["k"]: r.asDict() for r in out.collect()}
    assert got["1"]["t.a"] == "A" and got["1"]["t.b.c"] == "C" and got["1"]["s.a"] is None
    assert got["2"]["t.a"] is None and got["2"]["s.b.c"] == "C"


def test_merge_appends(spark):
    df = spark.range(1).select(F.expr("array('a','b') x"), F.expr("array('b') y"))
    assert run(df, mutate(merge={"x": "y"})).first().x == ["a", "b", "b"]


def test_cidr_skips_bad_input(spark):
    out = run(rows(spark, "ip", ["10.0.0.1", "nope", ""]), cidr("ip", ["bad", "10.0.0.5/8"], "in"))
    assert [r.tags for r in out.orderBy("ip").collect()] == [None, ["in"], None]


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text('"k1"," v1 "\nk2,"a, b"\nlonely\nk1,later\nk3,\n')
    got = {r.key: r.value for r in read_dictionary(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {"k1": "later", "k2": "a, b", "k3": ""}
    assert read_dictionary(spark, str(tmp_path / "no.csv"), missing_ok=True).count() == 0


def test_filter_on_parsed_field_does_not_repeat_extraction(spark):
    df = spark.range(10).select(F.concat(F.lit("n "), "id").alias("m"))
    out = run(df, grok("m", "n %{INT:n}")).filter("n = '3'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) == 1 and out.count() == 1


def test_unused_extraction_is_pruned(spark):
    df = spark.range(10).select("id", F.concat(F.lit("n "), "id").alias("m"))
    out = run(df, grok("m", "n %{INT:n}"), grok("m", "(?<w>n) ", tag_on_failure=[])).select("id", "w")
    assert len(re.findall(r"regexp_replace\(", out._jdf.queryExecution().optimizedPlan().toString())) == 1
