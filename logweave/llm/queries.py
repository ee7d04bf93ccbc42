"""Queries of the subpackage over the test tables, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import table
from logweave.llm.license_scan import BASE_PHRASES, LEAST_SHARE, NEIGHBOURS, NOTICES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(text: str, parting: str) -> str:
    """Words of a text, A-Z lower-cased, as a DuckDB list."""
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{parting}'), lambda x: x <> '')"


_SPACED, _LETTERED = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _sql_print(words: str) -> str:
    """The least 128 hashes of the runs of five words."""
    runs = f"""CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 5 THEN [array_to_string({words}, ' ')]
        ELSE list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' ')) END"""
    return f"list_sort(list_distinct(list_transform({runs}, lambda x: left(md5(x), 16))))[1:128]"


def _sql_near(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:128]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_intersect({a}, {b}), {union})) AS DOUBLE) / len({union}) END"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://(.*)', 1, 's') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
    coalesce(host, '') || coalesce(path, '') AS whole FROM parts
), globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_full_match(whole, '[^/]*cheap-pills[^/]*/.*', 's') THEN '*cheap-pills*/**'
    WHEN regexp_full_match(whole, '[^/]*spam-farm[^/]*/.*', 's') THEN '*spam-farm*/**'
    WHEN regexp_full_match(whole, '.*/wp-login[.]php', 's') THEN '**/wp-login.php'
    WHEN regexp_full_match(whole, '[^/]*cheap-pills[^/]*', 's') THEN '*cheap-pills*'
    WHEN regexp_full_match(whole, '[^/]*casino[^/]*/.*', 's') THEN '*casino*/**'
    WHEN regexp_full_match(whole, '[^/]*spam-farm[^/]*', 's') THEN '*spam-farm*'
    WHEN regexp_full_match(whole, '.*/ads/.*', 's') THEN '**/ads/**'
    WHEN regexp_full_match(whole, '[^/]*casino[^/]*', 's') THEN '*casino*'
    WHEN regexp_full_match(whole, '.*[.]exe', 's') THEN '**.exe' END AS pattern FROM ruled
)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM globbed
"""


@query("op6_url_globs", OP6_SQL)
def op6_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.url_globs import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


_TEMPLATES = ", ".join(f"({i}, '{label}', {phrase}, '{text}')" for i, (label, phrase, text) in enumerate(
    [(a, "true", t) for a, t in BASE_PHRASES] + [(a, "false", t) for a, t in NOTICES]))

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text", _LETTERED)} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d WHERE len(w) > 1),
t AS (SELECT template, label, phrase, string_split(t, ' ') AS w, len(w) - 1 AS runs FROM (VALUES {_TEMPLATES}) v(template, label, phrase, t)),
tg AS (SELECT template, label, phrase, runs, unnest(range(0, runs)) AS t_pos, unnest(list_transform(range(1, runs + 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t),
v AS (SELECT doc_id, template, label, phrase, runs, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS seen, min(pos) AS low, max(pos) AS high FROM g JOIN tg USING (g) GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new FROM v WHERE NOT phrase),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS sighting FROM m),
found AS (SELECT doc_id, label, phrase, low AS first_pos, 1.0::DOUBLE AS score FROM v WHERE phrase AND len(seen) = runs
    UNION ALL SELECT doc_id, label, phrase, first_pos, score FROM (SELECT doc_id, template, label, phrase, sighting, min(low) AS first_pos,
        CAST(count(DISTINCT t_pos) AS DOUBLE) / runs AS score FROM (SELECT *, unnest(seen) AS t_pos FROM n) GROUP BY doc_id, template, label, phrase, runs, sighting) WHERE score >= {LEAST_SHARE}),
per_doc AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first_pos) FILTER (phrase) AS first_word, max(first_pos) FILTER (phrase) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN per_doc USING (doc_id)
"""


@query("op9_license_diagonals", OP9_SQL)
def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logweave.llm.packing import packed_digest

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text", _LETTERED)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text", _LETTERED)} AS w, least(10, len(w)) AS n FROM benchmark),
bw AS (SELECT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM b WHERE n > 0),
dw AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, pos, n, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_winnowing", OP2_SQL)
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query("op7_robust_outliers")
def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.robust_quality import judged

    found = judged(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2")
    )


@query("op3_rule_ensemble")
def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.rule_ensemble import scored, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, train(docs, labels))


@query("op4_attentive_gru")
def op4_attentive_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.toxicity import scored, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, train(docs, labels))


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_sql_words("text", _SPACED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(y) AS component_id FROM s JOIN reach ON x = doc_id GROUP BY doc_id, g
"""


@query("op1_ngram_join", OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_column_bwt")
def op8_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.repeats import deduplicated

    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_page_wrapper")
def op5_page_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.page_wrapper import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS next FROM documents
    WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, next, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM t),
s AS (SELECT *, {_sql_words("text", _LETTERED)} AS w, {_sql_words("edited", _LETTERED)} AS we, {_sql_words("next", _LETTERED)} AS wn FROM e),
p AS (SELECT doc_id, length(text) AS n, edited, {_sql_print("w")} AS p, {_sql_print("we")} AS pe, {_sql_print("wn")} AS pn FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(p, '') AS fingerprint, array_to_string(pe, '') AS edited_fingerprint,
  {_sql_near("p", "pe")} AS near_edited, {_sql_near("p", "pn")} AS near_next FROM p
"""


@query("op13_document_fingerprints", OP13_SQL)
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.fingerprints import edited_digest

    return edited_digest(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


_CRC = """list_reduce(list_transform(range(1, length(hex(encode({0}))) + 1, 2), lambda i: CAST('0x' || substr(hex(encode({0})), i, 2) AS UBIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END, xor(c, b)),
    CAST(4294967295 AS UBIGINT))"""
"""CRC-32 of the UTF-8 bytes of a text, before its bits are turned around."""

OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
seen AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
summed AS (SELECT w, n, xor({_CRC.format("(doc_id || ':' || w)")}, CAST(4294967295 AS UBIGINT)) AS h FROM seen),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM summed),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
gaps AS (SELECT w, n, unnest(list_transform(range(1, length(w) + 1), lambda i: left(w, i - 1) || '?' || substr(w, i + 1))) AS gap,
    unnest(list_transform(range(1, length(w) + 1), lambda i: left(w, i - 1) || substr(w, i + 1))) AS without FROM v),
pairs AS (SELECT a.w, b.w AS o, b.n AS o_n FROM gaps a JOIN gaps b USING (gap) WHERE a.w <> b.w
    UNION SELECT a.w, b.w, b.n FROM gaps a JOIN v b ON a.without = b.w UNION SELECT b.w, a.w, a.n FROM gaps a JOIN v b ON a.without = b.w),
near AS (SELECT w, count(*) AS n_near, arg_min(o, (-o_n, o)) AS best, max(o_n) AS best_n FROM pairs GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (w)),
walk(w, r) AS (SELECT w, w FROM f UNION SELECT walk.w, f.form FROM walk JOIN f ON walk.r = f.w WHERE f.form IS NOT NULL),
last AS (SELECT walk.w, walk.r AS root FROM walk JOIN f ON walk.r = f.w WHERE f.form IS NULL)
SELECT f.w AS word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN last ON f.w = last.w
"""


@query("op11_spelling_groups", OP11_SQL)
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from logweave.llm.token_alignment import alignment_digest

    return alignment_digest(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
