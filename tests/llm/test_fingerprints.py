"""Fingerprints against a plain version, merging, and the order of ids over many ranges."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import fingerprints as fp

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, fingerprint string, Next int, __range int, words array<string>"


def shingles(text: str | None) -> set[str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(text: str | None, k: int = fp.K) -> list[str]:
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(text)})[:k]


def likeness(a: list[str], b: list[str], k: int = fp.K) -> float:
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé語") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 90, 400]))) for _ in range(70)]
    texts += [None, "", " \n\t ", "One two", "one TWO ", "a" * 3000, "word " * 4000, "日本語 𝒳𝒴 é" * 30, texts[0], texts[0]]
    rng.shuffle(texts)
    ids = sorted(rng.sample(range(-50, 5000), len(texts)))
    rows = list(zip(ids, texts, strict=True))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, ["y"]) for r in rows], DOCS)


def digests(rows):
    """The plain version, by id; repeated ids in the order of their texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 8, 50])
def test_digests(spark, docs, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = fp.edited_digest(frame(spark, docs)).drop("distinct_shingles", "held").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got), key=repr) == digests(docs)


@pytest.mark.parametrize("rows", [
    [], [(5, "one two three four five six")], [(7, None)], [(1, "a b"), (1, "a b"), (1, "c d e"), (2, None)],
    [(None, "null id " * 9), (None, "b"), (3, "c c c c c c c")], [(2**62, "far away"), (-(2**62), "other end")],
])
def test_hard_tables(spark, rows):
    got = fp.edited_digest(frame(spark, rows)).drop("distinct_shingles", "held").collect()
    assert sorted(map(tuple, got), key=repr) == digests(rows)


def test_ranges_keep_order(spark):
    edges, each = [-7, 0, 3, 1000], 5
    got = spark.range(-10, 1010).select("id", fp._range(F.col("id"), edges, each).alias("r")).orderBy("id").collect()
    numbers = [r.r for r in got]
    assert numbers == sorted(numbers) and len(set(numbers)) > 8


def test_merging_parts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(3000)]
    parts = [("long", " ".join(words[a : a + 104])) for a in range(0, 3000, 100)] + [("short", "one two"), ("none", None)]
    df = fp.fingerprinted(spark.createDataFrame(parts, "doc string, text string"))
    got = {r.doc: r.fingerprint for r in fp.merged(df, ["doc"]).collect()}
    assert got == {"long": plain(" ".join(words)), "short": plain("one two"), "none": []}
    two = df.filter("doc = 'long'").limit(1).crossJoin(df.filter("doc = 'short'").select(F.col("fingerprint").alias("other")))
    row = two.select("text", fp.united(F.col("fingerprint"), F.col("other")).alias("u")).first()
    assert row.u == sorted({*plain(row.text), *plain("one two")})[: fp.K]


def test_estimates(spark):
    """Resemblance, containment and distinct counts of large sets come near the true ones; small sets are exact."""
    a = " ".join(f"a{i}" for i in range(6000))
    b = " ".join(f"a{i}" for i in range(3000, 12000))
    df = spark.createDataFrame([(a, b), ("one two three four five six", "one two three four five seven")], "a string, b string")
    pair = fp.fingerprinted(fp.fingerprinted(df, "a", "pa"), "b", "pb")
    big, small = pair.select(
        fp.resemblance(F.col("pa"), F.col("pb")).alias("r"), fp.containment(F.col("pa"), F.col("pb")).alias("c"),
        fp.distinct_count(F.col("pa")).alias("n"), fp.distinct_count(F.col("pb")).alias("m"),
    ).collect()
    one, two = shingles(a), shingles(b)
    assert abs(big.r - len(one & two) / len(one | two)) < 0.13
    assert abs(big.c - len(one & two) / len(one)) < 0.2
    assert abs(big.n - len(one)) < 0.3 * len(one) and abs(big.m - len(two)) < 0.3 * len(two)
    assert (small.r, small.c, small.n, small.m) == (1 / 3, 0.5, 2.0, 2.0)


def test_no_python_in_the_plan(spark, docs):
    plan = fp.edited_digest(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_license_places_count_once(spark):
    """A template's place that stands on several merged diagonals is one place; only A-Z are lower-cased."""
    from logweave.llm import license_scan

    notice = dict(license_scan.NOTICES)["cc-by-nc"].split()
    rng = random.Random(4)
    texts = ["licensed under cc licensed under cc", "licensed under cc", " ".join(notice), " ".join(notice[:3] + ["x"] + notice[3:]), "Kind MIT License", "mit licenſe"]
    texts += [" ".join(rng.choice([*notice, "x"]) for _ in range(rng.randrange(5, 40))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]

    def plain(text: str) -> dict[str, float]:
        """Best share of each notice: its word pairs by diagonal, neighbouring diagonals together, each place once."""
        words = text.translate(UPPER).split()
        out: dict[str, float] = {}
        for label, template in license_scan.NOTICES:
            t = template.split()
            seen: dict[int, set[int]] = {}
            for p in range(len(words) - 1):
                for q in range(len(t) - 1):
                    if words[p : p + 2] == t[q : q + 2]:
                        seen.setdefault(p - q, set()).add(q)
            group, last = set(), None
            for d in sorted(seen):
                group = seen[d] | (group if last is not None and d - last <= license_scan.NEIGHBOURS else set())
                last = d
                share = len(group) / (len(t) - 1)
                if share >= license_scan.LEAST_SHARE:
                    out[label] = max(out.get(label, 0.0), share)
        return out

    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, words string, label int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert got[0].labels == "" and got[0].score == 0.0 and got[2].labels == "cc-by-nc" and got[2].score == 1.0
    assert (got[4].n_base, got[5].n_base, got[4].n_words) == (1, 0, 3)
    for i, text in rows[6:]:
        found = plain(text)
        assert got[i].labels == ",".join(sorted(found)) and got[i].score == pytest.approx(max(found.values(), default=0.0))


def test_names_of_elements_do_not_lose_articles(spark):
    """Class words drop an element only as a whole name, never the page, the article, a paragraph or most of the text."""
    from logweave.llm import page_wrapper

    body = "".join(f"<p>Paragraph {{n}} {c} of the story, with words of its own.</p>" for c in "abc")
    shapes = {
        "body": f'<body class="single no-sidebar"><div>{body}</div></body>', "article": f'<body><article class="post social">{body}</article></body>',
        "id": f'<body><article id="ad-astra">{body}</article></body>', "p": f'<body><article><p class="notice">Told {{n}}.</p>{body}</article></body>',
        "div": f'<body><article><div class="share-price">Price {{n}}.</div>{body}</article></body>', "section": f'<body><article><section class="related-work">Work {{n}}.</section>{body}</article></body>',
        "most": f'<body><div class="comments">{body}</div><div class="sidebar">x</div></body>',
        "gone": f'<body><div class="site-footer">Foot {{n}}</div><div id="cookie-banner2">Cookies {{n}}</div><ul class="share-links"><li>Share {{n}}</li></ul><aside>Aside {{n}}</aside>{body}</body>',
    }
    rows = [(f"{k}{n}", f"http://{k}.example/{n}", f"<html><head><title>t</title></head>{v.format(n=n)}</html>") for k, v in shapes.items() for n in range(8)]
    got = {r.page_id: r.text for r in page_wrapper.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    lead = {"p": "Told {n}.", "div": "Price {n}.", "section": "Work {n}."}
    for k in shapes:
        for n in range(8):
            blocks = ([lead[k].format(n=n)] if k in lead else []) + [f"Paragraph {n} {c} of the story, with words of its own." for c in "abc"]
            assert got[f"{k}{n}"] == "\n\n".join(blocks), k
