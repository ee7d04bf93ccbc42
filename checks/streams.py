"""Queries for streams, written routes, nested differences, pattern folders and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.core import pick, run
from checks.domain import _SETS, rules
from checks.registry import query, table
from logweave import Chain, branch, stage
from logweave import predicates as P
from logweave.functions.shared import new_folder
from logweave.operators import grok, mutate, translate
from logweave.operators.lookup import Lookup
from logweave.patterns import read_folder
from logweave.pipeline import dispatch
from logweave.plans import audit, cleanup, enrich, firewall, unwrap
from logweave.plans.full import parse_chain
from logweave.sinks import read_routed, write_batch
from logweave.sources import literal_table, read_dictionary, read_logs
from logweave.streaming import VersionedTable, latest_totals, stream_chain, stream_totals, stream_versions

PARTS = 3


def _line_files(spark: SparkSession, lines: DataFrame) -> str:
    """Lines (event_id, message) as a folder of three files, of every third line each, one written after the other."""
    folder = new_folder(spark, "lines")
    for part in range(PARTS):
        lines.filter(F.col("event_id") % PARTS == part).select("message").coalesce(1).write.mode("append").text(folder)
    return folder


def _filterlog(spark: SparkSession, sf: str) -> DataFrame:
    return L.program_lines(spark, sf, "filterlog").select("event_id", "message")


# ---- sink ----------------------------------------------------------------------------------


@query("route_written", f"""SELECT {_SETS} AS stream_dataset, 'logs' AS stream_type, event_id % 2 AS batch, count(*) AS lines, sum(event_id) AS ids FROM events GROUP BY ALL""")
def route_written(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, the first of them tried twice, the first try with lines that the second does not have."""
    path = new_folder(spark, "routed")
    lines = L.mixed_lines(spark, sf)
    done = (parse_chain() + Chain([stage("clean", *cleanup.cleanup())])).apply(lines)
    kept = done.select("event_id", "`event.original`", "`data_stream.dataset`", "`data_stream.namespace`")
    odd = kept.withColumn("data_stream.dataset", F.lit("pfelk.gone"))
    write_batch(odd.filter("event_id < 50"), path, 0)
    for batch in (0, 1, 0):
        write_batch(kept.filter(F.col("event_id") % 2 == batch), path, batch)
    found = read_routed(spark, path)
    return found.groupBy("stream_dataset", "stream_type", F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("lines"), F.sum("event_id").alias("ids"))


# ---- streams -------------------------------------------------------------------------------

_DESCRIPTION = f"CASE {L.RULE_UUID} WHEN '1000000101' THEN 'first rule' WHEN '1000000102' THEN 'second, later' WHEN '1000000103' THEN 'third rule' ELSE concat('Rule ID: ', {L.RULE_UUID}) END"


@query("stream_equals_batch", f"""SELECT CAST(event_id AS VARCHAR) AS line, {_DESCRIPTION} AS description, {L.SOURCE_IP} AS source, {L.ACTION} AS action, 'pfelk.firewall' AS dataset,
    event_id % 3 AS batch FROM events""")
def stream_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Lines read as a stream of three files, parsed, joined to rule names, written by route for each batch."""
    out = new_folder(spark, "stream")
    chain = Chain([stage("unwrap", *unwrap.unwrap()), stage("type", dispatch(*firewall.filterlog())), stage("rules", *enrich.rule_names(rules(spark))), stage("clean", *cleanup.cleanup())])
    stream = read_logs(spark, _line_files(spark, _filterlog(spark, sf)), preset="syslog", stream=True, maxFilesPerTrigger=1)
    wanted = ("log.syslog.procid", "rule.description", "source.ip", "event.action", "data_stream.dataset", "data_stream.namespace")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select(*(f"`{c}`" for c in wanted)), out, batch_id)

    stream_chain(stream, lambda: chain, write, new_folder(spark, "progress"), available_now=True).awaitTermination()
    found = read_routed(spark, out)
    return found.select(
        F.col("log.syslog.procid").alias("line"), F.col("rule.description").alias("description"), F.col("source.ip").alias("source"), F.col("event.action").alias("action"),
        F.col("stream_dataset").alias("dataset"), F.col("batch").cast("bigint").alias("batch"),
    )


@query("stream_audit_totals", """
    WITH n AS (SELECT count(*) AS c, count(*) FILTER (event_type = 'error') AS e FROM events)
    SELECT 'first' AS stage, 2 * c AS fields_added, 0 * c AS fields_modified, c AS fields_removed, c AS tags_added, 0 * c AS tags_removed FROM n
    UNION ALL SELECT 'second', 0, e, 0, 0, e FROM n UNION ALL SELECT NULL, 2 * c, e, c, c, e FROM n""")
def stream_audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of ``audit_totals``, kept as state over three batches."""
    kinds = table(spark, sf, "events").select("event_id", F.col("event_type").alias("message"))
    stream = read_logs(spark, _line_files(spark, kinds), tags=["x"], stream=True, maxFilesPerTrigger=1).select("message", "tags")
    audited = Chain([
        stage("first", mutate(add_field={"a": "1"}, add_tag=["x", "y"], rename={"message": "kind"})),
        stage("second", branch((P.eq("kind", "error"), [mutate(replace={"a": "2"}, remove_tag="x")]))),
    ]).apply(stream, audit=True)
    path = new_folder(spark, "totals")
    stream_totals(audited, path, new_folder(spark, "progress"), available_now=True).awaitTermination()
    return latest_totals(spark, path)


@query("stream_new_dictionary", """SELECT event_type AS kind, event_id % 3 AS batch, CASE WHEN event_id % 3 = 0 THEN 'old ' ELSE 'new ' END || event_type AS value, 2 AS plans, count(*) AS lines
    FROM events GROUP BY ALL""")
def stream_new_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of which a new version is published after the first of three batches: two plans, and no line with the wrong value."""
    out, folder = new_folder(spark, "stream"), new_folder(spark, "dictionary")
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("key")).distinct()
    published: list[str] = []

    def publish(word: str) -> None:
        path = f"{folder}/version={len(published)}"
        kinds.select("key", F.concat(F.lit(f"{word} "), "key").alias("value")).write.mode("overwrite").parquet(path)
        published.append(path)

    publish("old")
    names = VersionedTable(lambda: published[-1], lambda: Lookup(spark.read.parquet(published[-1])))
    source = _line_files(spark, table(spark, sf, "events").select("event_id", F.col("event_type").alias("message")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("message", "value").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id == 0 and len(published) == 1:
            publish("new")

    plans = stream_versions(
        lambda: read_logs(spark, source, stream=True, maxFilesPerTrigger=1), lambda: Chain([stage("name", translate("message", "value", names.current(), "none"))]),
        write, new_folder(spark, "progress"), [names], available_now=True,
    )
    found = spark.read.parquet(out).groupBy(F.col("message").alias("kind"), F.col("batch").cast("bigint").alias("batch"), "value").agg(F.count("*").alias("lines"))
    return found.withColumn("plans", F.lit(plans))


# ---- audit ---------------------------------------------------------------------------------


@query("audit_nested_diff", """SELECT event_id, 'v.a.z,v.new.k.deep' AS added, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v.a.x' END AS modified, 'v.a.y,v.gone.k' AS removed,
    CASE WHEN event_id % 2 = 0 THEN 'm.extra' ELSE '' END AS map_added FROM events""")
def audit_nested_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = "concat('{\"a\":{\"x\":', event_id % 3, ',\"y\":1},\"b\":[1,2],\"gone\":{\"k\":1}}')"
    after = "concat('{\"a\":{\"x\":0,\"z\":2},\"b\":[1,2],\"new\":{\"k\":{\"deep\":', event_id, '}}}')"
    df = table(spark, sf, "events")
    pairs = F.create_map(F.lit("same"), F.lit("1"))
    more = F.when(F.col("event_id") % 2 == 0, F.map_concat(pairs, F.create_map(F.lit("extra"), F.col("event_type")))).otherwise(pairs)
    old = df.select("event_id", F.parse_json(F.expr(before)).alias("v"), pairs.alias("m"))
    new = df.select("event_id", F.parse_json(F.expr(after)).alias("v"), more.alias("m"))
    diff = audit.row_diff(old, new, ["event_id"], depth=4)
    split = {k: F.filter(k, lambda p: p.startswith("v.")) for k in ("added", "modified", "removed")}
    maps = F.filter("added", lambda p: p.startswith("m."))
    return diff.select("event_id", *(F.array_join(c, ",").alias(k) for k, c in split.items()), F.array_join(maps, ",").alias("map_added"))


# ---- files ---------------------------------------------------------------------------------


@query("grok_pattern_folder", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, '' AS tags FROM events")
def grok_pattern_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Two pattern files made from the table: the second replaces a name of the first."""
    folder = new_folder(spark, "patterns")
    kinds = table(spark, sf, "events").select("event_type").distinct()
    first = spark.range(1).select(F.explode(F.array(F.lit("# kinds of events"), F.lit("KIND nothing"), F.lit(""), F.lit("WHO [0-9]+"))).alias("value"))
    first.coalesce(1).write.text(f"{folder}/10-base")
    kinds.agg(F.concat(F.lit("KIND (?:"), F.array_join(F.sort_array(F.collect_set("event_type")), "|"), F.lit(")")).alias("value")).coalesce(1).write.text(f"{folder}/20-own")
    names = read_folder(spark, folder)
    df = table(spark, sf, "events").select("event_id", F.concat(F.lit("saw "), "event_type", F.lit(" by "), "user_id").alias("line"))
    out = pick(run(df, grok("line", "^saw %{KIND:[kind]} by %{WHO:[who]}$", definitions=names)), "event_id", "kind", "who", "tags")
    return out.withColumn("tags", F.coalesce("tags", F.lit("")))


@query("dictionary_file", """SELECT event_id, CASE WHEN user_id % 40 < 25 THEN CASE WHEN n_nationkey % 5 = 0 THEN n_name || ', later' ELSE n_name END ELSE 'key ' || CAST(user_id % 40 AS VARCHAR) END AS name
    FROM events LEFT JOIN nation ON n_nationkey = user_id % 40""")
def dictionary_file(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary file of quoted values with blanks around them, in which later lines replace earlier ones."""
    path = new_folder(spark, "dictionary")
    nation = table(spark, sf, "nation")
    early = nation.select((F.col("n_nationkey") * 2).alias("place"), F.expr("concat('\"', n_nationkey, '\",\"', n_name, '\"')").alias("value"))
    later = nation.filter("n_nationkey % 5 = 0").select(F.lit(1000).alias("place"), F.expr("concat('\" ', n_nationkey, ' \",\" ', n_name, ', later \"')").alias("value"))
    early.union(later).union(spark.range(1).select(F.lit(2000).alias("place"), F.lit("lonely").alias("value"))).coalesce(1).sortWithinPartitions("place").select("value").write.text(path)
    df = table(spark, sf, "events").select("event_id", (F.col("user_id") % 40).cast("string").alias("k"))
    return pick(run(df, translate("k", "name", Lookup(read_dictionary(spark, path)), "key %{k}")), "event_id", "name")


# ---- stages and edits ----------------------------------------------------------------------


@query("stage_transform", """SELECT event_id, upper(event_type) AS kind, sum(value) OVER (PARTITION BY event_type, event_id % 7 ORDER BY event_id) >= 0 AS positive, 3 AS steps FROM events WHERE event_id % 2 = 0""")
def stage_transform(spark: SparkSession, sf: str) -> DataFrame:
    """A stage that is a plain function of the table, between stages of operators, with the audit records carried through it."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("event_type", F.col("event_id") % 7).orderBy("event_id")
    df = table(spark, sf, "events").filter("event_id % 2 = 0").select("event_id", "event_type", "value")
    out = Chain([
        stage("before", mutate(copy={"event_type": "kind"})),
        stage("plain", transform=lambda d: d.withColumn("positive", F.sum("value").over(so_far) >= 0)),
        stage("after", mutate(uppercase="kind"), mutate(remove_field="value")),
    ]).apply(df, audit=True)
    return out.select("event_id", "kind", "positive", F.size("audit").alias("steps"))


@query("merge_objects", """SELECT event_id, 'user' AS kept, event_type AS taken, CAST(user_id AS VARCHAR) AS added FROM events""")
def merge_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Merging one object into another: leaves of both, the merged one's where both have the leaf."""
    df = table(spark, sf, "events").select(
        "event_id", F.lit("user").alias("a.kept"), F.lit("old").alias("a.taken"), F.col("event_type").alias("b.taken"), F.col("user_id").cast("string").alias("b.deep.added")
    )
    return pick(run(df, mutate(merge={"a": "b"})), "event_id", kept="a.kept", taken="a.taken", added="a.deep.added")
