"""Wrappers of hosts with long pages and with many layouts."""

from __future__ import annotations

import random
from itertools import product

from logweave.llm.page_wrapper import extract, folded, merged, tokens
from logweave.sources import literal_table

NAMES = ["".join(x) for x in product("bcdfghjk", repeat=3)]


def test_template_of_long_pages_is_found(spark):
    """Two layouts of many hundred parts: constant text goes, as it does where pages are short."""

    def page(i: int, parts: int) -> str:
        body = "".join(f'<div class="{n}">text {n} of {i}</div>' for n in NAMES[:parts])
        extra = f'<div class="zzz">only here {i}</div>' if i % 2 else ""
        return f'<html><body><div class="lead">always the same</div>{body}{extra}<p>end of {i}</p></body></html>'

    rows = [(f"http://{host}.example/{i}", page(i, parts)) for host, parts in (("short", 5), ("long", 300)) for i in range(12)]
    for url, text in extract(literal_table(spark, rows, ["url", "html"])).select("url", "text").collect():
        assert "always the same" not in text, url
        assert f"end of {url.rpartition('/')[2]}" in text


def test_groups_do_not_nest_deeper_with_each_layout():
    rng = random.Random(5)

    def depth(items) -> int:
        return max((1 + depth(i[3]) for i in items if not isinstance(i, str) and i[0] == "g"), default=0)

    whole = None
    for i in range(60):
        names = rng.sample(NAMES[:40], rng.randrange(3, 12))
        own = folded(tokens("<html><body>" + "".join(f'<div class="{n}"><p>{n} of {i}</p></div>' for n in names) + "</body></html>"))
        whole = own if whole is None else merged(whole, own)
    assert depth(whole) <= 3
