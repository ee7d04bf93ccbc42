"""Parts of the operators that need no session, against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm.common import LETTER_WORDS, SPACE_WORDS, batch_hashes
from logweave.llm.decontaminate import _kept, _runs
from logweave.llm.ngram_join import unit_links
from logweave.llm.packing import OpenWindows, best_fit
from logweave.llm.page_wrapper import Wrapper, folded, merged, tokens
from logweave.llm.repeats import SPAN, _met, collection_index, pieces, repeated_windows
from logweave.llm.rule_ensemble import Test as RuleTest
from logweave.llm.rule_ensemble import fit as fit_rules
from logweave.llm.text_stats import COUNTS, text_counts
from logweave.llm.toxicity import LENGTH, STRIDE, windows
from logweave.llm.toxicity import fit as fit_network
from logweave.llm.url_globs import Automaton, split_url


def as_regex(glob: str) -> str:
    parts = re.findall(r"\*\*+|\*|\?|[^*?]", glob, re.DOTALL)
    return "".join(".*" if p.startswith("**") else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p) for p in parts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=8), min_size=1, max_size=30), st.lists(st.text("ab/cé", max_size=10), min_size=1, max_size=8))
def test_automaton_matches_like_regular_expressions(globs, texts):
    found = Automaton.of(globs).matches(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == bool(re.fullmatch(as_regex(g), t, re.DOTALL)), (g, t)


def test_automaton_crosses_words():
    globs = ["x" * n + "*" for n in range(1, 90)]
    found = Automaton.of(globs).matches(["x" * 70, "", "y"])
    assert found[0].tolist() == [n <= 70 for n in range(1, 90)] and not found[1:].any()


@pytest.mark.parametrize(
    ("url", "parts"),
    [(None, ("", "")), ("", ("", "")), ("/x/y", ("", "")), ("HTTP://ExÄ.net", ("exÄ.net", "")), ("http://a.b/c?d#e", ("a.b", "/c")), ("http://a?x/y", ("a", "")), ("a://b://c/d", ("b:", "//c/d"))],
)
def test_split_url(url, parts):
    assert split_url(url) == parts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_segment_tree_is_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset = best_fit(lengths, 20)
    free: list[int] = []
    used: dict[int, int] = {}
    for n, w, o in zip(lengths, where, offset, strict=True):
        left = 20 - used.get(w, 0)
        fits = [f for f in free if f >= n]
        assert left == (min(fits) if fits else 20) and o == used.get(w, 0)
        if fits:
            free.remove(left)
        used[w] = used.get(w, 0) + n
        free.append(left - n)


def test_open_windows_empty():
    tree = OpenWindows(8)
    assert tree.tightest(1) is None
    tree.put(3, 7)
    assert tree.tightest(4) is None and tree.tightest(2) == (3, 7) and tree.tightest(1) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=14), min_size=1, max_size=8))
def test_collection_index_sorts_suffixes(texts):
    raw = [t.encode() for t in texts]
    text, start, before, lcp = collection_index(raw, 5)
    # an end mark is less than every byte, and that of an earlier text less than that of a later one
    expected = sorted(((i, s) for i, t in enumerate(raw) for s in range(len(t) + 1)), key=lambda x: ([b + 1 for b in raw[x[0]][x[1] :]] + [0], x[0]))
    assert list(zip(text.tolist(), start.tolist(), strict=True)) == expected
    for k, (i, s) in enumerate(expected):
        assert (before[k] == 0) == (s == 0)
        if k:
            a, b = raw[expected[k - 1][0]][expected[k - 1][1] :], raw[i][s:]
            common = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(common, 5)


def test_repeated_windows_and_pieces():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcdef ") for _ in range(400))
    texts = [base[:200], base[100:300], b"x" * 160, b"x" * 60 + base[:90], b"", b"short"]
    doc, first, last, place, anchor, piece = pieces(texts)
    covered = {(d, w) for d, f, l in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True) for w in range(f, l + 1)}
    assert covered == {(d, w) for d, t in enumerate(texts) for w in range(len(t) - SPAN + 1)}
    by_window: dict[bytes, set] = {}
    for d, f, l, a in zip(doc.tolist(), first.tolist(), last.tolist(), anchor.tolist(), strict=True):
        assert l - f + SPAN < 2 * SPAN
        for w in range(f, l + 1):
            by_window.setdefault(texts[d][w : w + SPAN], set()).add(a)
    assert all(len(a) == 1 for a in by_window.values())
    met = _met([texts[d][f : l + SPAN] for d, f, l in zip(doc, first, last, strict=True)], anchor.tolist(), place.tolist(), doc.tolist())
    shared = {d for d in range(4) for e in range(4) if d != e and {texts[d][i : i + SPAN] for i in range(len(texts[d]) - SPAN + 1)} & {texts[e][i : i + SPAN] for i in range(len(texts[e]) - SPAN + 1)}}
    assert {int(doc[i]) for i in met} >= shared == {0, 1, 2, 3}
    found = set(zip(*(x.tolist() for x in repeated_windows(texts, np.array([5, 3, 9, 1, 2, 4]))), strict=True))
    ids, expected = [5, 3, 9, 1, 2, 4], set()
    for i, t in enumerate(texts):
        for w in range(len(t) - SPAN + 1):
            if any(ids[j] < ids[i] and t[w : w + SPAN] in u for j, u in enumerate(texts)):
                expected.add((i, w))
    assert found == expected and expected


def test_pieces_with_swapped_bytes_differ():
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(160))
    texts = [passage] + [passage[:i] + passage[i + 1 : i + 2] + passage[i : i + 1] + passage[i + 2 :] for i in range(len(passage) - 1)]
    doc, first, last, _, _, piece = pieces(texts)
    by_digest: dict[bytes, set] = {}
    for d, f, l, own in zip(doc.tolist(), first.tolist(), last.tolist(), piece, strict=True):
        by_digest.setdefault(own.tobytes(), set()).add(texts[d][f : l + SPAN])
    assert all(len(own) == 1 for own in by_digest.values()) and len(by_digest) > len(texts)


def test_winnowing_keeps_a_run_of_every_shared_span():
    rng = random.Random(5)
    for _ in range(50):
        shared = [rng.choice("abcdefgh") for _ in range(10)]
        texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8))] + shared + [rng.choice("abcdefgh") for _ in range(rng.randrange(8))] for _ in range(2)]
        kept = []
        for t in texts:
            flat, _ = batch_hashes([" ".join(t).encode()], LETTER_WORDS)
            runs = _runs(flat, 4)
            kept.append(set(runs[_kept(runs, np.arange(len(t) - 9), 10, 4)].tolist()))
        assert kept[0] & kept[1]


@pytest.mark.parametrize("blocks", [1, 2])
def test_unit_links_connects_like_brute_force(blocks):
    rng = random.Random(blocks)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(62) for _ in range(rng.choice([1, 3, 20, 60]))]
        for _ in range(rng.randrange(1, 12)):
            own = set(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 4) + 1)):
                own.discard(rng.choice(base))
                own.add(rng.getrandbits(62))
            sets.append(np.array(sorted(own), np.uint64))
    no = np.array(rng.sample(range(1000), len(sets)))
    block = np.array([rng.randrange(blocks) for _ in sets])

    def grouped(pairs):
        label = {int(n): int(n) for n in no}
        for a, b in pairs:
            x, y = label[a], label[b]
            label = {k: x if v == y else v for k, v in label.items()}
        return {k: min(j for j, w in label.items() if w == v) for k, v in label.items()}

    brute = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            o = len(np.intersect1d(a, b))
            if 100 * o >= 80 * (len(a) + len(b) - o) and (blocks == 1 or block[i] != block[j]):
                brute.append((int(no[i]), int(no[j])))
    found = unit_links(no, sets, block)
    assert grouped(found) == grouped(brute) and set(map(frozenset, found)) <= set(map(frozenset, brute)) and len(found) < len(sets)


def plain_counts(t: str) -> dict[str, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + j for i, w in enumerate(three) if three.count(w) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(twice), "n_lines": len(lines), "n_distinct_words": len(set(words)), "n_upper": len(re.findall("[A-Z]", t)),
    }


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é#|\n\t!1\x85\xa0", max_size=40)), max_size=6))
def test_text_counts(texts):
    found = text_counts([None if t is None else t.encode() for t in texts])
    assert set(found) == set(COUNTS)
    for i, t in enumerate(texts):
        for name, value in plain_counts(t or "").items():
            assert found[name][i] == value, (name, t)


def test_word_maps():
    text = "Straße—Ünï 12a_b\u00a0c K".encode()
    assert text.translate(LETTER_WORDS).split() == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "straße—Ünï 12a_b\u00a0c k")]
    assert b"A\x0bb\x1cC".translate(SPACE_WORDS).split() == [b"a", b"b\x1cc"]


def test_rule_ensemble_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 11))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.3)).astype(float)
    model = fit_rules(x[:2000], y[:2000])
    score = np.full(1000, model.base)
    for rule, weight in model.rules:
        score += weight * np.logical_and.reduce([t.holds(x[2000:]) for t in rule])
    assert ((score > 0) == (y[2000:] > 0.5)).mean() > 0.97
    assert all(isinstance(t, RuleTest) for rule, _ in model.rules for t in rule)
    assert fit_rules(x[:0], y[:0]).rules == () and fit_rules(x[:5], np.ones(5)).base > 0


def test_windows_cover_and_overlap():
    n = np.array([0, 1, LENGTH, LENGTH + 1, 10 * LENGTH + 3])
    text, first = windows(n)
    for i, m in enumerate(n):
        own = first[text == i]
        assert len(own) == 0 if m == 0 else set(range(m)) == {w for f in own for w in range(f, min(f + LENGTH, m))}
        assert (np.diff(own) == STRIDE).all() and STRIDE < LENGTH


def test_passages_of_half_a_window_lie_whole_in_one():
    for n in range(1, 5 * LENGTH):
        _, first = windows(np.array([n]))
        most = min(n, LENGTH // 2)
        assert all(((first <= w) & (w + most <= first + LENGTH)).any() for w in range(n - most + 1))


def test_network_finds_marked_windows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]

    def text(bad: bool) -> bytes:
        own = [rng.choice(words) for _ in range(rng.choice([10, 50, 120]))]
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["vile", "rotten"])
        return " ".join(own).encode()

    y = np.array([i % 2 for i in range(400)], float)
    model = fit_network([text(v == 1) for v in y], y)
    scores = model.scores([text(True) for _ in range(40)] + [text(False) for _ in range(40)] + [None, b"", b"..."])
    assert (scores[:40] >= 0.7).mean() > 0.9 and (scores[40:80] >= 0.7).mean() < 0.1 and (scores[80:] == 0).all()
    again = model.scores([text(True)] * 2)
    assert again[0] == again[1]
    alike = fit_network([b"a"], np.array([1.0])).scores([b"a", b""])
    assert alike.tolist() == [0.5, 0.0]


PAGE = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><!-- <p>no</p> --><div class='ad x'>Buy</div>"
    "<article><h1>Head &amp; more</h1>{body}</article><div class=comments><p>first!</p></div><footer>&copy; me</footer></body>"
)


def test_wrapper_of_a_host():
    pages = [PAGE.format(nav="<li><a href=x>n</a></li>" * i, body="".join(f"<p>Para <b>{i}</b>&nbsp;{j}<br>x</p>" for j in range(i))) for i in (1, 2, 5)]
    pages.append(PAGE.format(nav="", body="<p>open<p>open two<ul><li>a<li>b</ul><form>name <input></form>"))
    wrapper = None
    for p in pages:
        wrapper = folded(tokens(p)) if wrapper is None else merged(wrapper, folded(tokens(p)))
    found = Wrapper(wrapper)
    for p in pages:
        assert found.pattern.fullmatch("".join(found.codes[k] for k, _ in tokens(p)))
    assert found.blocks(tokens(pages[1])) == ["Head & more", "Para 2 0 x", "Para 2 1 x"]
    assert found.blocks(tokens(pages[3])) == ["Head & more", "open", "open two", "a", "b"]
    assert found.blocks(tokens("")) == [] and found.blocks(tokens("<p")) == []


def test_wrapper_without_article_drops_fixed_text():
    pages = [f"<div><p>Always here</p><div class=body><p>{w} one</p><p>{w} two</p></div></div>" for w in "abcdef"]
    wrapper = folded(tokens(pages[0]))
    for p in pages[1:]:
        wrapper = merged(wrapper, folded(tokens(p)))
    assert Wrapper(wrapper).blocks(tokens(pages[2])) == ["c one", "c two"]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><article><h1>A</h1><p>b</article>", ["A", "b"]),
        ("<head><title>T</title><article><p>a</article>", ["a"]),
        ("<head><title>T</title>a <b>b</b><p>c", ["a b", "c"]),
        ("<article><p>a <svg width=1 /> b<p>c<svg><text>no</text></svg> d</article>", ["a b", "c d"]),
        ("<article><p>a<svg><path d=x><p>b<svg><svg><text>no</text></svg></svg><p>c</article>", ["a", "b", "c"]),
        ("<article><p>a <math/> b<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", ["a b", "let x=1 be"]),
        ("<article><p>a</p><object data=x><param name=y>instead</object><p>b</article>", ["a", "instead", "b"]),
        ("<article><p>a</p><object data=x><p>b</p><iframe src=y><p>c</article>", ["a", "b", "c"]),
        ("<article><p>a</p><select><option>no</select><noscript>no</noscript><template><p>no</template><iframe>no</iframe><script>no", ["a"]),
    ],
)
def test_elements_that_end_early_or_never(page, blocks):
    assert Wrapper(folded(tokens(page))).blocks(tokens(page)) == blocks


def wrapper_of(pages):
    wrapper = folded(tokens(pages[0]))
    for p in pages[1:]:
        wrapper = merged(wrapper, folded(tokens(p)))
    return Wrapper(wrapper)


def test_template_texts_within_the_article():
    """Notices inside of the article whose tags and classes say nothing; one of them only some pages have."""
    page = "<article><h1>{0} head</h1><div class=x1><b>Get our letter</b></div><p>{0} one</p>{1}<div class=x3>All rights</div></article>"
    pages = [page.format(w, "<section><h3>In short</h3>a <b>price</b> cut</section>" if i % 2 else "") for i, w in enumerate("abcdefghijkl")]
    found = wrapper_of(pages)
    assert found.blocks(tokens(pages[2])) == ["c head", "c one"] and found.blocks(tokens(pages[3])) == ["d head", "d one"]
    other = tokens(page.format("z", "<section><h3>In long</h3>new</section>"))
    assert found.blocks(other) == ["z head", "z one", "In long", "new"]


def test_copies_are_no_template():
    page = "<article><h1>Head</h1><p>one</p></article>"
    assert wrapper_of([page] * 9).blocks(tokens(page)) == ["Head", "one"]
