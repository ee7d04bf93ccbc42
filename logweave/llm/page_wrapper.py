"""HTML extraction by union-free regular-expression inference.

Pages of one host come from one template. A page is read as a stream of block tags and texts; inline tags belong to the
text around them, and end tags that HTML lets authors omit are put in. Tandem repeats of a stream are folded into repeated
groups. Streams of a host are then aligned one after the other with the wrapper so far: texts that differ become slots,
parts that one side lacks become optional groups, a literal that the other side repeats joins that group. The result is a
regular expression without unions which every page of the host matches. Texts that it has as literals, on enough
different pages and also within optional groups, are template; slots and repeated groups are content. What is boilerplate by
its tag, or by a whole name of its class, id or role, goes as well, and where a page has ``article`` or ``main``, what is outside of it.

Pages of a host are aligned within their task first; what leaves a task is a wrapper for each host, not a page. Wrappers of
a host are merged in two steps, the first of which deals them to several tasks, so a host with a third of all pages is no
more than a few hundred wrappers. Extraction joins each page to its host's wrapper.

Cases: a null or empty page, or one without text, has the empty text. Unclosed tags end where their parent ends, an unclosed
head before the first text or tag that cannot stand in it; stray end tags are ignored. Of script, style, textarea and title
the rest of the page goes if they have no end tag; of noscript, template, iframe, svg and select only the tag itself. Pages without a host share one wrapper. A wrapper has as many parts as the layouts of
its host need. Repeated rows are extracted alike. Empty tables give no rows. Output
columns take the place of input columns of the same name.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import fresh, with_columns, written
from logweave.llm.url_globs import split_url

# Fixed values of HTML: tags without content, tags whose content is no text, tags that run within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title"
DROPPED = frozenset("noscript template iframe svg select".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br"
    " math annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup"
    " mtable mtd mtext mtr munder munderover semantics".split()
)
# Fixed values of HTML: an open element is ended by these.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}),
}
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button head title".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb comment comments cookie cookies footer header login menu nav navbar newsletter notice popup promo"
    " related share sidebar social sponsor subscribe".split()
)
PLACE_WORDS = frozenset(
    "area articles bar block bottom box col column container content entry form global group inner item items left line link links list main module outer page panel"
    " posts primary rail right row secondary section site slot stories sub top unit widget wrap wrapper".split()
)
"""Words that say where something stands; beside one of the others in a class they change nothing, any other word does."""
ARTICLE_TAGS = frozenset({"article", "main"})
KEPT_TAGS = ARTICLE_TAGS | frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody blockquote pre figcaption".split())
"""Elements that no class makes boilerplate: the page, the article and what texts are made of."""

FOLD = 24
LEAST_PAGES = 5
"""Texts that never change are template text only if so many pages of different texts have them; copies count once."""

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.DOTALL | re.IGNORECASE
)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)

Item = str | list
"""A tag ('<p', '</p'); a text ['#', marks of pages, text or None for a slot, path]; a group ['g', least, repeated, items]."""


def _dropped(found: list[re.Match]) -> dict[int, int]:
    """Tags that begin an element without article text, and where its end tag ends; those without one are not among them."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, m in enumerate(found):
        if m[3] is not None and (name := m[3].lower()) in DROPPED:
            own = open_.setdefault(name, [])
            if not m[2]:
                if not m[4].endswith("/"):
                    own.append(i)
            elif own:
                ends[own.pop()] = m.end()
    return ends


def tokens(page: str) -> list[tuple[str, str]]:
    """Block tags and texts, ('<div.ad', ''), ('#', text), with omitted end tags."""
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    text: list[str] = []
    at = 0

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        text.clear()
        if words:
            if in_head():
                close(len(open_) - 1)
            out.append(("#", " ".join(words)))

    def in_head() -> bool:
        return bool(open_) and open_[-1].partition(".")[0] == "head"

    def close(upto: int) -> None:
        while len(open_) > upto:
            out.append((f"</{open_.pop()}", ""))

    found = list(_TOKEN.finditer(page))
    ends = _dropped(found)
    for i, m in enumerate(found):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in DROPPED:
            at = ends.get(i, at)
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].partition(".")[0] == name:
                    close(i)
                    break
            continue
        if in_head() and name not in IN_HEAD:
            close(len(open_) - 1)
        while open_ and name in ENDED_BY.get(open_[-1].partition(".")[0], ()):
            close(len(open_) - 1)
        marks = sorted({re.sub("[0-9]+", "0", w.lower().replace(".", "-")) for c in _CLASS.finditer(m[4]) for w in next(x for x in c.groups() if x is not None).split()})
        symbol = ".".join([name, *marks])
        if name in VOID or m[4].endswith("/"):
            continue
        out.append((f"<{symbol}", ""))
        open_.append(symbol)
    rest = page[at:]
    text.append(rest[: rest.rfind("<")] if re.search(r"<[/a-zA-Z!][^>]*\Z", rest) else rest)  # a tag that the end cuts off is no text
    flush()
    close(0)
    return out


def key(item: Item) -> str:
    if isinstance(item, str):
        return item
    return "#" if item[0] == "#" else "(" + " ".join(map(key, item[3])) + ")"


def paths(stream: list[tuple[str, str]]) -> Iterator[int]:
    """For each symbol of a page's stream a hash of the tags that are open there."""
    open_ = [0]
    for k, _ in stream:
        if k.startswith("</"):
            open_.pop()
        elif k != "#":
            open_.append(zlib.crc32(k.encode(), open_[-1]))
        yield open_[-1]


def folded(stream: list[tuple[str, str]]) -> list[Item]:
    """A page's stream with tandem repeats as groups; texts in groups are slots."""
    mark = zlib.crc32("\n".join(t for _, t in stream).encode("utf-8", "surrogatepass"))
    items: list[Item] = [["#", [mark], t, at] if k == "#" else k for (k, t), at in zip(stream, paths(stream), strict=True)]
    changed = True
    while changed:
        codes: dict[str, str] = {}
        coded = "".join(codes.setdefault(k, chr(0x4E00 + len(codes))) for k in map(key, items))
        out, at, changed = [], 0, False
        for m in re.finditer(r"(.{1,%d}?)\1+" % FOLD, coded):
            size = len(m[1])
            first = items[m.start() : m.start() + size]
            if not isinstance(first[0], str) or not first[0].startswith("</"):
                out += items[at : m.start()]
                out.append(["g", 1, True, [slotted(i) for i in first]])
                at, changed = m.end(), True
        items = out + items[at:]
    return items


def slotted(item: Item) -> Item:
    if isinstance(item, str):
        return item
    return ["#", [], None, 0] if item[0] == "#" else ["g", item[1], item[2], [slotted(i) for i in item[3]]]


def _grouped_alike(items: list[Item], other: list[Item]) -> list[Item]:
    """``items`` with literals that the other side has as a group in such a group."""
    groups = {tuple(map(key, i[3])): i for i in other if not isinstance(i, str) and i[0] == "g"}
    for keys in sorted(groups, key=len, reverse=True):
        out, at = [], 0
        own = [key(i) for i in items]
        while at < len(items):
            if tuple(own[at : at + len(keys)]) == keys:
                alike = items[at : at + len(keys)]
                out.append(["g", 1, groups[keys][2], [slotted(i) for i in alike] if groups[keys][2] else alike])
                at += len(keys)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _optional(items: list[Item]) -> list[Item]:
    """Groups become optional ones; what stands between them becomes an optional group, so groups do not nest deeper with each page."""
    out: list[Item] = []
    plain: list[Item] = []
    for item in items:
        if isinstance(item, str) or item[0] == "#":
            plain.append(item)
            continue
        if plain:
            out.append(["g", 0, False, plain])
            plain = []
        out.append(["g", 0, item[2], item[3]])
    return [*out, ["g", 0, False, plain]] if plain else out


def _both(a: Item, b: Item) -> Item:
    """Two items of one key as one."""
    if isinstance(a, str):
        return a
    if a[0] == "#":
        return ["#", sorted({*a[1], *b[1]})[:LEAST_PAGES], *a[2:]] if a[2:] == b[2:] else slotted(a)
    return ["g", min(a[1], b[1]), a[2] or b[2], [_both(x, y) for x, y in zip(a[3], b[3], strict=True)]]


def merged(a: list[Item], b: list[Item]) -> list[Item]:
    """A wrapper that matches whatever either matches."""
    if list(map(key, a)) != list(map(key, b)):
        a, b = _grouped_alike(a, b), _grouped_alike(b, a)
    keys_a, keys_b = list(map(key, a)), list(map(key, b))
    if keys_a == keys_b:
        return [_both(x, y) for x, y in zip(a, b, strict=True)]
    out: list[Item] = []
    i, j = 0, 0
    for x, y, n in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_matching_blocks():
        out += _optional(a[i:x]) + _optional(b[j:y])
        out += [_both(p, q) for p, q in zip(a[x : x + n], b[y : y + n], strict=True)]
        i, j = x + n, y + n
    return out


def _named_boilerplate(symbol: str) -> bool:
    """Whether a class, id or role says so: one whole name of boilerplate words and words of place, nothing else."""
    name, *marks = symbol.lstrip("</").split(".")
    if name in KEPT_TAGS:
        return False
    for mark in marks:
        words = {w for w in re.split("[^a-z]+", mark) if w}
        if words & BOILERPLATE_WORDS and words <= BOILERPLATE_WORDS | PLACE_WORDS:
            return True
    return False


def _boilerplate(stream: list[tuple[str, str]]) -> list[bool]:
    """For each symbol of a page, whether it opens an element that is boilerplate by its tag or name.

    An element that holds more than half of the page's text is not boilerplate, whatever it is called.
    """
    out, inside, open_, seen = [False] * len(stream), [0] * len(stream), [], 0
    for i, (k, t) in enumerate(stream):
        if k == "#":
            seen += len(t)
        elif k.startswith("</"):
            at = open_.pop()
            inside[at] = seen - inside[at]
        else:
            inside[i] = seen
            open_.append(i)
    for i, (k, _) in enumerate(stream):
        if k != "#" and not k.startswith("</"):
            tag = k[1:].partition(".")[0] in BOILERPLATE_TAGS
            out[i] = tag or _named_boilerplate(k) and 2 * inside[i] <= seen
    return out


def _is_article(symbol: str) -> bool:
    return symbol[1:].partition(".")[0] in ARTICLE_TAGS


class Wrapper:
    """A wrapper as a regular expression over symbols, with its template texts and the paths they stand at."""

    def __init__(self, items: list[Item]):
        self.codes: dict[str, str] = {}
        self.fixed = {(i[3], i[2]) for i in self._literals(items)}
        self.article = any(map(_is_article, self._symbols(items)))
        self.pattern = re.compile(self._compiled(items), re.DOTALL)

    def _literals(self, items: list[Item]) -> Iterator[Item]:
        for i in items:
            if i[0] == "#" and i[2] is not None and len(i[1]) >= LEAST_PAGES:
                yield i
            elif i[0] == "g" and not i[2]:
                yield from self._literals(i[3])

    def _symbols(self, items: list[Item]) -> Iterator[str]:
        for i in items:
            if isinstance(i, str):
                yield i
            elif i[0] == "g":
                yield from self._symbols(i[3])

    def code(self, symbol: str) -> str:
        return self.codes.setdefault(symbol, chr(0x4E00 + len(self.codes)))

    def _compiled(self, items: list[Item]) -> str:
        out = []
        for i in items:
            if isinstance(i, str):
                out.append(self.code(i))
            elif i[0] == "#":
                out.append(self.code("#"))
            else:
                out.append(f"(?:{self._compiled(i[3])}){'*' if i[2] and not i[1] else '+' if i[2] else '' if i[1] else '?'}")
        return "".join(out)

    def blocks(self, stream: list[tuple[str, str]]) -> list[str]:
        """The texts of the article."""
        article = self.article and any(_is_article(k) for k, _ in stream)
        out, depth_bad, depth_in, open_ = [], 0, 0, []
        for (k, t), at, gone in zip(stream, paths(stream), _boilerplate(stream), strict=True):
            if k == "#":
                if not depth_bad and (depth_in or not article) and (at, t) not in self.fixed:
                    out.append(t)
            elif k.startswith("</"):
                bad, inside = open_.pop()
                depth_bad -= bad
                depth_in -= inside
            else:
                state = (gone, _is_article(k))
                open_.append(state)
                depth_bad += state[0]
                depth_in += state[1]
        return out


def _loaded(wrapper: str) -> list[Item]:
    return json.loads(wrapper)


def infer_wrappers(pages: DataFrame, url: str, page: str, salts: int = 16) -> DataFrame:
    """A row for each host: host, wrapper (as JSON)."""

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[Item]] = {}
        for pdf in parts:
            for u, p in zip(pdf["url"], pdf["page"], strict=True):
                host = split_url(u if isinstance(u, str) else None)[0]
                own = folded(tokens(p)) if isinstance(p, str) else []
                found[host] = merged(found[host], own) if host in found else own
        yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(w, ensure_ascii=False) for w in found.values()]}, dtype=object)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole: list[Item] | None = None
        for w in sorted(pdf["wrapper"]):
            whole = _loaded(w) if whole is None else merged(whole, _loaded(w))
        return pd.DataFrame({"host": [str(pdf["host"].iloc[0])], "wrapper": [json.dumps(whole, ensure_ascii=False)]}, dtype=object)

    rows = pages.select(F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("page"))
    parts = rows.mapInPandas(within, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    first = parts.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return first.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with text (the article's blocks, parted by empty lines) and n_chars."""
    wrappers = written(infer_wrappers(pages, url, page)).withColumnRenamed("host", "wrapper_host")
    host, wrapper = fresh(pages.columns, "page_host"), fresh(pages.columns, "host_wrapper")

    @F.pandas_udf("string")
    def host_of(urls: pd.Series) -> pd.Series:
        return pd.Series([split_url(u if isinstance(u, str) else None)[0] for u in urls], dtype=object)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Wrapper] = {}
        for html_, own in parts:
            out = np.full(len(html_), "", object)
            for i, (p, w) in enumerate(zip(html_, own, strict=True)):
                if isinstance(p, str) and p:
                    if w not in known:
                        if len(known) > 500:
                            known.clear()
                        known[w] = Wrapper(_loaded(w))
                    out[i] = "\n\n".join(known[w].blocks(tokens(p)))
            yield pd.Series(out, dtype=object)

    named = pages.withColumn(host, host_of(F.col(f"`{url}`").cast("string")))
    joined = named.join(wrappers.withColumnRenamed("wrapper", wrapper), F.col(host) == F.col("wrapper_host"), "left").drop("wrapper_host")
    out = with_columns(joined, {"text": text_of(F.col(f"`{page}`").cast("string"), F.col(wrapper))})
    return out.withColumn("n_chars", F.length("text").cast("long")).drop(host, wrapper)
