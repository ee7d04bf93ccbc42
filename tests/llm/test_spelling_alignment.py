"""Spelling groups and token alignment against plain versions, on hard texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers as public
import pytest

from logweave.llm import spelling, token_alignment
from logweave.llm.token_alignment import Aligner, segments

A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, word string, N int, block string, pair long, at int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "b", 2, 3) for r in rows], DOCS).repartition(parts)


# ---- spelling ------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows, letters=5, least=3):
    counts: Counter[str] = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        forms[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out.append((w, n, len(others)))

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w], root(w), n, m, words.get(forms[w])) for w, n, m in out) if words else []


def got_groups(spark, rows, parts=3):
    out = spelling.spelling_groups(frame(spark, rows, parts)).collect()
    return sorted((tuple(r) for r in out), key=lambda r: r[0])


def variant_rows(seed=11):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdelé") for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["hello", "hellllo", "aaaaa", "aaaaaa", "Ärger", "STRASSEN"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abl") + w[at + 1 :]])
            words.append(w)
        rows.append((i * 7, rng.choice([" ", ", ", "1", "-"]).join(words)))
    return rows


def test_spelling_groups(spark):
    rows = variant_rows()
    rows += [(5000, None), (5001, ""), (5002, "12 34 §§"), (None, "hello " * 5), rows[0], rows[0], (5003, "x" * 20_000 + " " + "long " * 9), (5004, "日本 ß÷×ÿ " * 4)]
    rows += [(6000 + i, " ".join(["chainaa"] * 3 + ["chainab"] * 7 + ["chainbb"] * 16)) for i in range(2)]
    expected = plain_groups(rows)
    assert len(expected) > 60 and any(r[1] and r[2] != r[1] for r in expected) and any(r[4] == 0 for r in expected)
    assert got_groups(spark, rows) == expected
    assert got_groups(spark, rows, 11) == expected


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "ab ab ab")], [(1, "abcde abcde")], [(1, "abcde " * 3)], [(1, "abcde " * 3 + "abcdx " * 3 + "abcdy " * 6)]])
def test_small_spelling_tables(spark, rows):
    assert got_groups(spark, rows) == plain_groups(rows)


def test_many_words_in_one_range(spark):
    """One place with every letter: a row per word leaves the range, and ties take the first word in order."""
    letters = "abcdefghijklmnopqrstuvwxyzéà"
    rows = [(7, " ".join(f"hat{c}n" for c in letters for _ in range(3 if c != "m" else 8)) + " hatn hatn hatn hatn hatn hatn")]
    got = {r[0]: r for r in got_groups(spark, rows)}
    assert sorted(got.values()) == plain_groups(rows)
    assert got["hatan"][1] == "hatmn" and got["hatan"][4] == len(letters) - 1
    words = spark.createDataFrame([(f"hat{c}n", 3) for c in letters], "word string, n long")
    assert spelling.near_words(words).count() == len(letters)


def test_long_chain_of_forms(spark):
    chain, word = [], "aaaaaaaaaaaa"
    for i in range(9):
        chain.append(word)
        word = word[:i] + "b" + word[i + 1 :]
    words = spark.createDataFrame([(w, chain[i + 1] if i + 1 < len(chain) else None) for i, w in enumerate(chain)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(words).collect()} == {w: chain[-1] for w in chain}


def test_words_of_a_text_without_damage():
    assert spelling.words_of(1, "Äb ÄB cd-CD", damaged=None) == {"Äb": 2, "cd": 2}
    damaged = [w for i in range(3000) if (w := next(iter(spelling.words_of(i, "abcdef")))) != "abcdef"]
    assert 10 < len(damaged) < 60 and all(len(w) == 5 for w in damaged)


# ---- tokens --------------------------------------------------------------------------------


def plain_tokens(text):
    """Both lists of ids with the bytes of each, of the whole text at once; None where they spell something else."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    if "a" not in KEPT:
        KEPT["a"], KEPT["b"] = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        KEPT["a"].encode_special_tokens = True
    a = KEPT["a"].encode(f" {text}", add_special_tokens=False).ids
    b = KEPT["b"].encode(text)
    letters = token_alignment.byte_letters()
    ab = [bytes(letters[c] for c in KEPT["a"].id_to_token(i)) for i in a]
    bb = []
    for i in b:
        p = KEPT["b"].id_to_piece(i)
        bb.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    whole = f" {text}".encode()
    return (a, b, ab, bb) if b"".join(ab) == whole == b"".join(bb) else None


KEPT: dict = {}


def plain_alignment(rows):
    found = [(i, plain_tokens(t)) for i, t in rows]
    links, groups = [], []
    for _, tokens in found:
        mine, text = [], []
        if tokens:
            a, b, ab, bb = tokens
            ae, be = list(accumulate(map(len, ab))), list(accumulate(map(len, bb)))
            mine = [(x, y) for x, e in zip(a, ae, strict=True) for y, f in zip(b, be, strict=True) if e == f]
            last = 0
            for end in sorted(set(ae) & set(be)):
                text.append("|".join(",".join(str(t) for t, e in zip(ids, ends, strict=True) if last < e <= end) for ids, ends in ((a, ae), (b, be))))
                last = end
        links.append(mine)
        groups.append(text)
    counts = Counter(p for mine in links for p in mine)
    best: dict = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, tokens), mine, text in zip(found, links, groups, strict=True):
        n_a, n_b = (len(tokens[0]), len(tokens[1])) if tokens else (0, 0)
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if text else ""
        out.append((i, n_a, n_b, len(text), len(mine), sum(counts[p] == best[p[1]] for p in mine), sum(counts[p] for p in mine), digest))
    return sorted(out, key=repr)


HARD = [
    "plain words, and more", "a  b", "  lead", "trail ", "trail  \n ", " ", "   ", "\n", "\n\n x\t y \r\n z", "don't I'll we've 12345 6.5e-7", "日本語の文 テスト 𝒳𝒴 🎉🎉 é́",
    "<|endoftext|> <s> </s> <unk> <0x0A> x<|endoftext|>y", "a▁b c", "▁", "nul \x00 \x1c \x1f sep \x85 nbsp  x   em　wide", "ﬁ ½ ²", "x" * 3000, "supercalifragilistic " * 300,
    "​ zero ﻿ bom", "tab\t tab", "A    B", "ends nbsp ", "  starts",
]


def test_alignment(spark):
    rng = random.Random(2)
    rows = list(enumerate(HARD)) + [(100, None), (101, ""), (None, "null id"), (0, HARD[0]), (0, HARD[0])]
    alphabet = list("ab  \n\t'.,1é日▁") + ["the ", " of", " "]
    rows += [(200 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    expected = plain_alignment(rows)
    for parts in (1, 6):
        got = token_alignment.alignment_digest(frame(spark, rows, parts), A_PATH, B_PATH).collect()
        assert sorted(map(tuple, got), key=repr) == expected
    assert any(r[5] != r[4] for r in expected) and sum(r[1] == 0 for r in expected) > 3


def test_small_blocks_and_a_short_memory(spark, monkeypatch):
    """The same counts whatever the blocks; the aligner that forgets gives the same groups."""
    rows = [(i, t) for i, t in enumerate(HARD * 3)]
    aligner = Aligner(A_PATH, B_PATH)
    whole = aligner.block([t for _, t in rows])
    monkeypatch.setattr(token_alignment, "KEPT_SEGMENTS", 5)
    parts = [aligner.block([t for _, t in rows[a : a + 4]]) for a in range(0, len(rows), 4)]
    assert [d for p in parts for d in p[1]] == whole[1]
    assert [list(n) for p in parts for n in p[0]] == [list(n) for n in whole[0]]
    assert [list(p[3]) for p in parts if len(p[3])] and sum(len(p[3]) for p in parts) == len(whole[3])


def test_segments_keep_every_letter():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab  \n ") for _ in range(rng.randrange(1, 12)))
        cut = segments(text)
        assert " ".join(cut) == text
        assert all(s and not s[-1].isspace() for s in cut[:-1]) and (cut[-1] or len(cut) == 1)


def test_empty_alignment(spark):
    assert token_alignment.alignment_digest(frame(spark, []), A_PATH, B_PATH).collect() == []
    assert [tuple(r)[1:] for r in token_alignment.alignment_digest(frame(spark, [(1, None)]), A_PATH, B_PATH).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_token_groups_spell_the_text(spark):
    rows = [(i, t) for i, t in enumerate(HARD)]
    got = defaultdict(list)
    for r in token_alignment.token_groups(frame(spark, rows), A_PATH, B_PATH).orderBy("doc_id", "group").collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        tokens = plain_tokens(t)
        assert (i in got) == (tokens is not None)
        if tokens:
            assert [x for r in got[i] for x in r.a] == tokens[0] and [x for r in got[i] for x in r.b] == tokens[1]
            assert [r.start for r in got[i]] == [0, *(r.stop for r in got[i][:-1])] and got[i][-1].stop == len(f" {t}".encode())
