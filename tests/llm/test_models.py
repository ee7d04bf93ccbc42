"""The models' mathematics against plain versions: gradients, the lasso's conditions; very long, repeated and equal texts."""

from __future__ import annotations

import numpy as np
import pytest

from logweave.llm import page_wrapper, rule_ensemble, toxicity


def test_gradients_are_those_of_the_loss():
    """Each parameter's gradient against differences of the loss, in windows with padding."""
    rng = np.random.default_rng(5)
    texts = [b"alpha", b"beta", b"gamma", b"x", b"delta"]
    words = toxicity.Words.of(texts, np.sort(toxicity.Words.of(texts, np.empty(0, np.uint64)).trigrams.astype(np.uint64))[:0])
    p = {k: v.astype(np.float64) for k, v in toxicity._fresh_params(rng, 0).items()}
    index = np.array([[0, 1, 2, 5], [3, 3, 4, 1], [2, 5, 5, 5]])
    mask = np.array([[1, 1, 1, 0], [1, 1, 1, 1], [1, 0, 0, 0]], np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss() -> float:
        x = np.vstack([words.vectors(p).astype(np.float64), np.zeros((1, toxicity.WORD_DIM + toxicity.CHAR_DIM))])
        logit = toxicity._forward(p, x, index, mask)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    g = toxicity._gradients(p, words, index, mask, y)
    assert g.keys() == p.keys()
    for name, value in p.items():
        flat, found = value.reshape(-1), np.asarray(g[name]).reshape(-1)
        places = np.flatnonzero(found) if name in ("word", "char") else np.arange(len(flat))
        for i in rng.choice(places, min(6, len(places)), replace=False):
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert found[i] == pytest.approx((up - down) / (2 * step), abs=2e-4), (name, i)


def test_the_lasso_meets_its_conditions():
    """At the least penalized loss the slope of each weight is the penalty against its sign, or within it at zero."""
    rng = np.random.default_rng(2)
    held = rng.random((600, 12)) < 0.3
    truth = np.zeros(12)
    truth[[0, 3]] = 2.5, -2.0
    y = (rng.random(600) < 1 / (1 + np.exp(-(held @ truth - 0.3)))).astype(float)
    penalty = 0.02
    base, w = rule_ensemble._lasso(held, y, penalty)
    gap = 1 / (1 + np.exp(-(held @ w + base))) - y
    slope = held.T @ gap / len(y)
    assert abs(gap.mean()) < 2e-3
    for weight, s in zip(w, slope, strict=True):
        assert abs(s + np.sign(weight) * penalty) < 2e-3 if abs(weight) > 1e-4 else abs(s) < penalty + 2e-3
    assert np.count_nonzero(np.abs(w) > 1e-4) < 12 and w[0] > 0.5 and w[3] < -0.5


@pytest.fixture(scope="module")
def labelled(spark):
    bad, good = "vile hate filth scum ", "calm river stone cloud "
    rows = [(i, (bad if i % 2 else good) * (3 + i % 9) + f"w{i}", i % 2, (i + 1) % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, x) for i, _, x, q in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [rule_ensemble, toxicity])
def test_very_long_repeated_and_odd_texts(spark, labelled, module):
    """Every row gets a score; equal texts get equal ones; a toxic passage shows in a very long text."""
    model = module.train(*labelled)
    long = "calm river stone cloud " * 30_000
    rows = [(1, long), (2, long[:300_000] + "vile hate filth scum " * 12 + long[:300_000]), (3, "x" * 400_000), (4, None), (5, ""), (6, "\n \t"), (7, "same text here"), (7, "same text here"),
            (None, "same text here"), (8, "日本語 🎉 \x00")]
    docs = spark.createDataFrame([(*r, 0.5, 9, "t") for r in rows], "doc_id long, text string, score double, Predicted int, n_words string")
    got = module.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, i): r for i, r in enumerate(sorted(got, key=lambda r: (r.doc_id or 0, r.score)))}
    same = {round(r.score, 6) for r in got if r.doc_id in (7, None)}
    assert len(same) == 1 and len(by) == len(rows)
    assert len({round(r.score, 6) for r in got if r.doc_id in (4, 5)}) == 1
    if module is toxicity:
        score = {r.doc_id: r.score for r in got}
        assert score[2] > 0.7 > score[1]


def test_a_very_long_page(spark):
    """All of a page of some megabytes comes out, deep nesting included."""
    many = "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(30_000))
    deep = "<div>" * 900 + "<p>deep down</p>" + "</div>" * 900
    rows = [(1, "http://a.example/1", f"<html><body><main>{many}</main></body></html>"), (2, "http://a.example/2", f"<html><body><main>{deep}</main></body></html>"), (3, None, None)]
    got = {r.page_id: r for r in page_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text.count("\n\n") == 29_999 and got[1].text.endswith("Paragraph 29999 of a long page.")
    assert got[2].text == "deep down" and (got[3].text, got[3].n_chars) == ("", 0)
