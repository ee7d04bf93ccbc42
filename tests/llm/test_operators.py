"""Every operator on a small table of hard cases, against brute force; empty tables; columns in the way."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logweave.llm import (
    decontaminate,
    license_scan,
    ngram_join,
    packing,
    page_wrapper,
    repeats,
    robust_quality,
    rule_ensemble,
    toxicity,
    url_globs,
)
from logweave.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lettered(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


@pytest.fixture(scope="module")
def rows():
    """Texts of all kinds: clean, junk, copies, near copies, shared passages, benchmark passages, licenses, odd ones."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeioutnrs") for _ in range(rng.randrange(2, 9))) for _ in range(300)]

    def prose(n: int) -> list[str]:
        return [rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n)]

    passage, item = prose(60), prose(25)
    out = []
    base = prose(200)
    for i in range(60):
        words = prose(rng.choice([60, 120, 300]))
        if i % 6 == 0:
            words = base.copy()
            for _ in range(rng.randrange(8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if i % 5 == 0:
            words[20:20] = passage
        if i % 9 == 0:
            words[5:5] = item[rng.randrange(10) :]
        if i % 7 == 0:
            words[9:9] = ["Released", "under", "the", "MIT", "License."]
        if i % 11 == 0:
            words = [w.upper() + "!!" for w in words]
        out.append([" ".join(words).capitalize(), "en" if i % 3 else "de", f"src{i % 4}"])
    out += [list(out[6]), list(out[6]), [None, None, None], ["", "en", None], [" \n\t ", "en", "src0"], ["one two", "en", "src1"], ["One two ", "de", "src1"]]
    out += [["word " * 3000, "en", "src0"], ["é" * 30 + "日本語" * 30, "fr", "src1"], ["x" * 5000, "en", "src2"], ["general public\nlicense MIT, license GENERAL public license", "en", "src0"]]
    docs = [(i, t, a, b, len(t or "")) for i, (t, a, b) in enumerate(out)]
    return docs, [(0, " ".join(item)), (1, " ".join(item[3:20])), (2, "one two"), (3, None), (4, ""), (None, " ".join(item)), (5, " ".join(item))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows[0], DOCS).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def hard(spark, rows):
    """The same rows, some again, some without an id, with columns whose names the operators use."""
    more = [*rows[0], rows[0][5], rows[0][5], (None, rows[0][8][1], "en", "src1", 3), (None, None, "en", "src1", 3)]
    names = ("row", "spans", "key", "found", "KEPT", "bad_id", "n_words", "score", "hit_id", "block", "ids")
    return spark.createDataFrame(more, DOCS).withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text: str | None) -> set:
    words = spaced((text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def linked(rows) -> dict[int, int]:
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("unit", [3_000_000, 500])
def test_ngram_join(docs, rows, unit):
    expected = {i: (len(shingles(t)), c) for (i, t, *_), c in zip(rows[0], linked(rows[0]).values(), strict=True)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, unit_shingles=unit).collect()}
    assert found == expected and sum(c != i for i, (_, c) in expected.items()) > 5


def test_ngram_join_hard(hard, rows, empty):
    label = linked(rows[0])
    found = ngram_join.near_duplicates(hard).collect()
    assert len(found) == hard.count() and all(r.component_id == (label[r.doc_id] if r.doc_id is not None else None) for r in found)
    kept = ngram_join.one_of_each(hard)
    assert kept.columns == hard.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect())
    assert ids == sorted(i for i, c in label.items() if i == c)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (100, 103)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated(text, benchmark) -> tuple:
    words, hit, items = lettered(text), set(), set()
    for item, t in benchmark:
        own = lettered(t)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        items.add(str(item))
    return len(words), len(hit), sorted(items), bool(hit)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_winnowing(spark, hard, rows, bound):
    benchmark = spark.createDataFrame(rows[1], "item_id long, text string").withColumn("spots", F.lit(1))
    texts = {r[0]: r[1] for r in rows[0]}
    found = decontaminate.contamination(hard, benchmark, broadcast_windows=bound).collect()
    assert len(found) == hard.count()
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == contaminated(texts[r.doc_id], rows[1])
    assert sum(r.contaminated for r in found) > 5
    if bound:
        left = decontaminate.decontaminated(hard, benchmark)
        assert left.columns == hard.columns
        clean = {i for i, t in texts.items() if not contaminated(t, rows[1])[3]}
        assert {r.doc_id for r in left.collect()} - {None} == clean


def test_winnowing_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0


def removed(rows) -> dict[int, tuple]:
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    out, seen = {}, set()
    for i in sorted(raw):
        b, gone = raw[i], bytearray(len(raw[i]))
        own = [b[j : j + 50] for j in range(len(b) - 49)]
        for j, s in enumerate(own):
            if s in seen:
                gone[j : j + 50] = b"\1" * 50
        seen.update(own)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_PIECES, 1])
def test_repeats_of_hot_anchors(docs, rows, hot):
    expected = removed(rows[0])
    for r in repeats.deduplicated(docs, hot_pieces=hot).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]


def test_repeats(hard, rows, empty):
    expected = removed(rows[0])
    found = repeats.deduplicated(hard, buckets=5).collect()
    assert len(found) == hard.count()
    for r in found:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]
        else:
            assert r.n_removed == 0
    left = repeats.without_repeats(hard, length="n_chars")
    assert left.columns == hard.columns
    for r in left.filter("doc_id IS NOT NULL").collect():
        assert r.text == expected[r.doc_id][3].decode("utf-8", "ignore") and r.n_chars == len(r.text) and r.spans == "spans"
    gone = {i for i, (_, n, _, kept) in expected.items() if n and not kept.strip()}
    assert {r.doc_id for r in left.collect()} - {None} == set(expected) - gone
    assert repeats.deduplicated(empty).count() == 0 and repeats.without_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="integer"):
        repeats.deduplicated(hard, doc_id="lang")


def test_repeats_with_swapped_bytes(spark):
    """A passage with two neighbouring bytes swapped, at every place: only what is the same may go."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(160))
    texts = [passage] + [f"{passage[:i]}{passage[i + 1]}{passage[i]}{passage[i + 2 :]}" for i in range(len(passage) - 1)]
    own = [(i, t, None, None, len(t)) for i, t in enumerate(texts)]
    expected = removed(own)
    for r in repeats.deduplicated(spark.createDataFrame(own, DOCS).repartition(3, "doc_id")).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]


def plain_rules(text) -> tuple:
    words = spaced(text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {w: three.count(w) for w in set(three)} if len(words) < 2000 else dict.fromkeys(three, 2)
    twice = {i + j for i, w in enumerate(three) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice), n < 50 or 100 * len(twice) > 50 * n


def test_robust_quality(hard, rows, empty):
    texts = {r[0]: r[1] for r in rows[0]}
    found = robust_quality.judged(hard, least_rows=15).collect()
    assert len(found) == hard.count()
    for r in found:
        if r.doc_id is not None:
            counts = plain_rules(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts
            shouts = (texts[r.doc_id] or "").count("!!") > 20
            assert r.kept == (not counts[-1] and not shouts), (r.doc_id, r.distance2)
    left = robust_quality.without_outliers(hard, least_rows=15)
    assert left.columns == hard.columns and left.count() == sum(r.kept for r in found)
    assert robust_quality.judged(empty).count() == 0 and robust_quality.without_outliers(empty).count() == 0


def test_determinant_estimates_resist_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    good = rng.normal(0.3, 0.05, (900, robust_quality.D))
    bad = rng.normal(0.9, 0.02, (100, robust_quality.D))
    table = spark.createDataFrame([("a", "s", *map(float, x)) for x in np.vstack([good, bad])], "lang string, source string, " + ", ".join(f"{c} double" for c in robust_quality.X))
    found = {r.level: r for r in robust_quality.estimates(table).collect()}
    for level in (0, 1, 2):
        assert all(abs(found[level][m] - 0.3) < 0.02 for m in robust_quality.MU) and found[level].n >= 700


def test_licenses(hard, rows, empty):
    texts = {r[0]: r[1] for r in rows[0]}
    found = license_scan.scan_licenses(hard).collect()
    assert len(found) == hard.count()
    for r in found:
        if r.doc_id is not None:
            words = lettered(texts[r.doc_id])
            places = [(i, label) for label, p in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({label for _, label in places})) and 0 <= r.score <= 1
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_notices_with_changes(spark):
    mpl = dict((a, t) for a, t in license_scan.NOTICES)["mpl"].split()
    changed = mpl[:6] + ["very", "new"] + mpl[6:]
    other = ["nothing"] * 5 + mpl[:4]
    texts = [(1, "a b " + " ".join(mpl)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(mpl[::-1]))]
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[1] == ("mpl", 1.0) and found[2][0] == "mpl" and 0.8 < found[2][1] < 1 and found[3] == ("", 0.0) and found[4][0] == ""


URLS = [
    (0, "http://a.example.net/en/x?y"), (1, "https://EXAMPLE.com/de/"), (2, "http://x.org/fr/1"), (3, "http://x.net"), (4, "http://x.net/?q"), (5, None), (6, ""),
    (7, "no-scheme/x"), (8, "http://example.com/de"), (9, "http://evil.com/a.net/b"), (10, "http://www.cheap-pills.io/a/b"), (11, "http://q.io/a/ads/b#z"),
    (12, "http://q.io/" + "a" * 9000 + ".exe"), (13, "http://notexample.net/en/1"), (None, "http://x.net/1"), (1, "https://EXAMPLE.com/de/"),
]


def test_urls(spark):
    table = spark.createDataFrame(URLS, "page_id long, url string").withColumns({"Host": F.lit(1), "judged": F.lit(2)})
    found = [(r.page_id, r.host, r.rule, r.pattern, r.verdict) for r in url_globs.judge_urls(table).collect()]
    by_id = {f[0]: f[1:] for f in found}
    assert len(found) == len(URLS)
    assert by_id[0] == ("a.example.net", "example.net/en/", None, "allow") and by_id[1] == ("example.com", "example.com/de/", None, "block")
    assert by_id[2] == ("x.org", "org/fr/", None, "allow") and by_id[3][1:] == (None, None, "allow") and by_id[4][1:] == ("net/", None, "block")
    assert by_id[5] == by_id[6] == by_id[7] == ("", None, None, "allow") and by_id[8][1:] == (None, None, "allow") and by_id[9][3] == "allow"
    assert by_id[10][2:] == ("*cheap-pills*/**", "block") and by_id[11][2:] == ("**/ads/**", "block") and by_id[12][2:] == ("**.exe", "block")
    assert by_id[13][1] == "net/" and by_id[None][3] == "block"
    assert url_globs.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pages(spark):
    page = "<body><nav><a>n</a></nav><article><p>One &amp;\n two<p>é &lt;3</article><footer>f</footer>"
    table = spark.createDataFrame([(1, "http://a.b/1", page), (1, "http://a.b/1", page), (2, None, None), (3, "http://a.b/2", ""), (4, None, page), (5, "x", "just text & more")], "page_id long, url string, html string")
    table = table.withColumns({"TEXT": F.lit("old"), "page_host": F.lit(1)})
    found = [(r.page_id, r.text, r.n_chars) for r in page_wrapper.extract(table).collect()]
    one = "One & two\n\né <3"
    assert sorted(found) == [(1, one, 15), (1, one, 15), (2, "", 0), (3, "", 0), (4, one, 15), (5, "just text & more", 16)]
    assert page_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def labelled(spark, bad):
    rng = random.Random(9)
    rows = []
    for i in range(500):
        words = [rng.choice(["ab", "cde", "fgh", "ij", "klmno", "pqr", "st", "uv"]) + rng.choice("aeiou") for _ in range(rng.choice([20, 60, 90]))]
        if i % 3 == 0:
            words = bad(words, rng)
        rows.append((i, " ".join(words), i % 3))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "ab cd")], "doc_id long, text string").withColumns({"y": F.lit(1), "score": F.lit(2)})
    labels = spark.createDataFrame([(i, int(k == 0)) for i, _, k in rows] + [(9500, 1), (4, None), (None, 1)], "doc_id long, mark int")
    return docs, labels, {i: int(k == 0) for i, _, k in rows}


def check_scores(found, truth, threshold):
    assert {r.doc_id for r in found} == {*truth, 9001, 9002, None} and len(found) == len(truth) + 3
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_rules_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark, lambda words, rng: [w + "##" if rng.random() < 0.5 else w for w in words])
    check_scores(rule_ensemble.scored(docs, rule_ensemble.train(docs, labels, "mark")).collect(), truth, 0.5)
    blank = labels.filter("false")
    assert {r.score for r in rule_ensemble.scored(docs, rule_ensemble.train(docs, blank, "mark")).collect()} == {0.5}
    assert rule_ensemble.scored(empty, rule_ensemble.RuleEnsemble(0.0, ())).count() == 0


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark, lambda words, rng: words[:5] + [rng.choice(["vile", "rotten"])] + words[5:])
    check_scores(toxicity.scored(docs, toxicity.train(docs, labels, "mark")).collect(), truth, 0.7)
    none = toxicity.train(docs, labels.filter("false"), "mark")
    assert toxicity.scored(empty, none).count() == 0


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """Where toxic texts are rare, the sample has as many as there may be, not those of the first labels."""
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 7).cast("int").alias("mark"))
    learnt = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: learnt.extend(y.tolist()))
    toxicity.train(labels.select("doc_id", F.lit("some words").alias("text")), labels, "mark", sample=700)
    assert (learnt.count(1), learnt.count(0)) == (700, 1400)


def test_packing(spark, hard, rows, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = {r[0]: r[1] or "" for r in rows[0]}
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    found = packing.packed_digest(hard, path, partitions=2).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        assert 0 < r.length <= 1024
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            by_doc.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert by_doc == {i: {(s, len(x[s : s + 1024]), packing.crc32_of(x[s : s + 1024]), len(x)) for s in range(0, len(x), 1024)} for i, x in ids.items()}
    for parts in by_sequence.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= 1024
    total = sum(r.length for r in found)
    assert total > 0.8 * 1024 * (len(by_sequence) - 2)
    assert packing.packed_digest(empty, path).count() == 0


def test_encoder_keeps_little_and_what_recurs(monkeypatch):
    """Beyond the limits, chunks met again stay and the others go; long chunks count by their ids; ids stay the tokenizer's."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 1000)
    monkeypatch.setattr(packing, "CACHE_IDS", 20_000, raising=False)
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoded, plain = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: encoded.append(set(texts)) or plain(texts))
    common = [f"often{i}" for i in range(100)]

    def coded(words):
        text = " ".join(["x", *words])
        ids, ends = encoder.encode([text], 0)
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0] and ends.tolist() == [len(ids)]

    for part in range(12):
        coded([*common, *(f"once{part}x{i}" for i in range(400))])
        assert len(encoder.hashes) <= 1000 + 500
    assert not any(" often0" in texts for texts in encoded[1:])
    for part in range(6):  # few chunks, but many ids
        coded([f"{part}" + "qz" * 6000 + f"{i}" for i in range(4)])
    assert len(encoder.hashes) < 900 and len(encoder.ids) <= 20_000 + 50_000


def test_packing_of_special_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [end, f"one{end}two", f"one {end} two", f"one  {end}  two\n{end}", f"{end} one", f"one {end}", f"{end}{end} ", f"<|endof {end[:-1]} one {end}two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for as_text in (False, True):
        plain = Tokenizer.from_file(path)
        if as_text:
            plain.encode_special_tokens = True
        ids = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        found = packing.packed_digest(docs, path, special_as_text=True) if as_text else packing.packed_digest(docs, path)
        assert {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in found.collect()} == {i: (packing.crc32_of(x), len(x)) for i, x in enumerate(ids)}


def test_sha_of_no_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.contamination(docs, none).select(F.sha2(F.concat_ws(",", "items"), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"").hexdigest()
