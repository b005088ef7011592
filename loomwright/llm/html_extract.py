"""Operator 3: main text by consensus host paths.

A tolerant tokenizer turns a page into text blocks, each under a path of containers. The path is
generalised: tag names with class names whose digits are masked, inline and list markup left out. Per
page every container gets a score: the text of the blocks it holds directly counts whole, that of its
grandchildren half, text in links against it; menus, headers, footers, sidebars, notices, adverts,
forms, comments and the like never count. Per host the scores of each path are summed over all its pages
in Spark (partial sums before the shuffle, so a hot host is a few rows), and the path with the greatest
sum wins. An article may consist of several containers, so the winner climbs: to the nearest `article`
or `main` that it lies in, else to the lowest ancestor that holds `MOST` of the host's text. Each page is
then extracted again below that path, or below its own best container (which climbs alike) where the page lacks it.

Defined results: null, empty and markup-only html give an empty text; a url without a host belongs to
the empty host; repeated pages are extracted each and vote each; ties go to the smaller path; an empty
table gives an empty result; only page_id, url and html are read, so other columns may bear any name. Nothing is
cut off a long page, and its time is linear: where quotes pair up to the page's end, tags end at the next `>`;
a tag that never ends is dropped with what follows; containers more than `DEPTH` deep share the path of that level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .url_filter import host_of

#: Elements whose content is not markup, and of no interest.
_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|title|select|xmp|noembed|noframes"
_RAW_TAGS = frozenset(_RAW.split("|"))
#: Of these, those that hold the rest of the page if they are never closed.
_SWALLOW = frozenset("script style title textarea xmp noembed noframes iframe template".split())
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW_TAGS}
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that hold text but are no containers of their own: they leave no trace in a path.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption address hgroup summary details center".split())
_DROP = frozenset("nav header footer aside form button menu dialog".split())
_NOISE = re.compile(
    r"(?:\A|[-_ ])(?:ads?|advert\w*|adslot|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|sidebars?|side|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|respond|replies|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|pagination|pager|tags|byline|copyright|legal|disclaimer|skip)(?:\Z|[-_ ])",
    re.I,
)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CLOSES_P = _LEAF - frozenset("li dt dd tr td th caption thead tbody tfoot".split()) | frozenset("div article main section nav header footer aside form hr body".split())
#: An opening tag of the key ends an open element of the value, up to the nearest of the stops.
_IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ())}


#: The share of a host's text that its article holds at least, and the levels of containers that paths tell apart.
MOST, DEPTH = 0.9, 256


def tokens(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Comments, declarations, whole raw elements (tag None) and tags: (start, end, closing, tag, attributes)."""
    at, n, broken, unclosed = 0, len(html), False, set()
    while m := _OPEN.search(html, at):
        start, tag = m.start(), m[2]
        if tag is None:
            stop = "-->" if m[0] == "<!--" else ">"
            end = html.find(stop, m.end())
            at = n if end < 0 else end + len(stop)
            yield start, at, False, None, ""
            continue
        end = -1
        if not broken:
            i = m.end()
            while s := _STOP.search(html, i):
                if s[0] == ">":
                    end = s.start()
                    break
                i = html.find(s[0], s.end()) + 1
                if i == 0:
                    break
            broken = end < 0
        if end < 0:
            end = html.find(">", m.end())
        if end < 0:
            yield start, n, False, None, ""
            return
        attrs, tag, at = html[m.end() : end], tag.lower(), end + 1
        if tag in _RAW_TAGS and not m[1]:
            close = None if tag in unclosed else _CLOSE[tag].search(html, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else n if tag in _SWALLOW else at
            yield start, at, False, None, ""
        else:
            yield start, at, bool(m[1]), tag, attrs


def _step(tag: str, attrs: str) -> tuple[str, bool]:
    """A container's part of the path, and whether it is noise."""
    noise = tag in _DROP
    if not attrs or attrs.isspace():
        return tag, noise
    name = ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            noise = noise or key == "hidden"
        elif key == "role":
            noise = noise or value.lower() in _NOISE_ROLE
        else:
            noise = noise or _NOISE.search(value) is not None
            if key == "class" and value.split():
                name = "." + re.sub(r"\d+", "#", ".".join(sorted(value.lower().split())))
    return tag + name, noise


def blocks(html: str) -> list[tuple[str, str, int, bool]]:
    """The text blocks of a page in order: (path of containers, text, its characters in links, noise)."""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path, noise
    open_: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link, at, deep = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                out.append((stack[-1][1], text, min(linked, len(text)), stack[-1][2]))
            buffer.clear()
        linked = 0

    def push(tag: str, path: str, noise: bool) -> None:
        nonlocal deep
        stack.append((tag, path, noise))
        open_[tag] += 1
        deep += tag not in _LEAF

    def cut_to(i: int) -> None:
        nonlocal deep
        for tag, _, _ in stack[i:]:
            open_[tag] -= 1
            deep -= tag not in _LEAF
        del stack[i:]

    def pop_to(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(open_[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                cut_to(i)
                return
            if stack[i][0] in stops or stack[i][0] not in _LEAF:
                return

    for start, end, closing, tag, attrs in tokens(html):
        if start > at:
            piece = html[at:start]
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if tag is None:
            continue
        if closing:
            if tag in _INLINE:
                in_link -= tag == "a" and in_link > 0
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    cut_to(i)
                    break
                if tag in _LEAF and stack[i][0] not in _LEAF:
                    break  # a stray end of a leaf closes no container
            continue
        if tag in _INLINE:
            in_link += tag == "a"
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if tag in _CLOSES_P:
            pop_to(("p",), ())
        if tag in _IMPLIED:
            pop_to(*_IMPLIED[tag])
        _, path, noise = stack[-1]
        if tag in ("html", "body", "head"):
            if tag == "body":
                cut_to(1)
                push("body", "", False)
            else:
                push(tag, path, noise or tag == "head")
        elif tag in _LEAF:
            push(tag, path, noise or _step(tag, attrs)[1])
        else:
            step, own = _step(tag, attrs)
            if tag == "header" and (open_["article"] or open_["main"]):
                own = _NOISE.search(attrs) is not None  # the article's own header holds its title
            push(tag, f"{path}/{step}" if deep < DEPTH else path, noise or own)
            if attrs.endswith("/") and not tag.isalpha():
                cut_to(len(stack) - 1)
    if at < len(html):
        buffer.append(html[at:])
    flush()
    return out


def worths(page: list[tuple[str, str, int, bool]]) -> tuple[dict[str, float], dict[str, float]]:
    """Of every container that holds text or is above one that does: its score, and the text below it that is worth something."""
    score: dict[str, float] = {}
    below: dict[str, float] = {}
    own: dict[str, float] = {}
    for path, text, linked, noise in page:
        if not noise:
            own[path] = own.get(path, 0.0) + len(text) - 2.0 * linked
    for path, worth in own.items():
        score[path] = score.get(path, 0.0) + worth
        up = path.rpartition("/")[0]
        if path:
            score[up] = score.get(up, 0.0) + worth / 2
        if worth > 0:
            for at in above(path):
                below[at] = below.get(at, 0.0) + worth
    return score, below


def above(path: str) -> list[str]:
    """The path and its ancestors, lowest first."""
    out = [path]
    while path:
        path = path.rpartition("/")[0]
        out.append(path)
    return out


def climb(path: str, below: dict[str, float]) -> str:
    """The container of the whole article that the path lies in."""
    up = above(path)
    for p in up:
        if p.rpartition("/")[2].partition(".")[0] in ("article", "main"):
            return p
    return next((p for p in up if below.get(p, 0.0) >= MOST * below.get("", 0.0)), "")


def best(of: dict[str, float]) -> str | None:
    """The container with the greatest positive score; ties go to the smaller path."""
    top = [(-s, p) for p, s in of.items() if s > 0]
    return min(top)[1] if top else None


def text_below(page: list[tuple[str, str, int, bool]], path: str) -> str | None:
    """The blocks below a path, joined; None if the page has no such block."""
    deep = path + "/"
    found = [text for at, text, _, noise in page if not noise and (at == path or at.startswith(deep) or not path)]
    return " ".join(found) if found else None


def extract(html: str | None, path: str | None) -> str:
    page = blocks(html or "")
    text = text_below(page, path) if path is not None else None
    if text is None:
        score, below = worths(page)
        own = best(score)
        text = text_below(page, climb(own, below)) if own is not None else None
    return text or ""


def host_votes(pages: DataFrame) -> DataFrame:
    """host, path, score, below: the summed score of each path on each host, and the text below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                score, below = worths(blocks(html.as_py() or ""))
                for path in score.keys() | below.keys():
                    s = sums.setdefault((host, path), [0, 0])
                    s[0] += max(0, round(score.get(path, 0.0) * 2))
                    s[1] += round(below.get(path, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), *(pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(2))], ["host", "path", "score", "below"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, score long, below long")
    return votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("below").alias("below"))


def consensus(pages: DataFrame) -> DataFrame:
    """host, path: each host's winning path, at the level of the whole article."""
    votes = cut(host_votes(pages))  # a row per path of a host
    ranked = F.min(F.struct((-F.col("score")).alias("score"), "path")).alias("top")
    winners = votes.filter("score > 0").groupBy("host").agg(ranked).select("host", F.col("top.path").alias("best"))
    total = votes.filter("path = ''").select("host", F.col("below").alias("total"))
    ways = votes.join(winners, "host").join(total, "host", "left")
    ways = ways.filter((F.col("path") == "") | (F.col("best") == F.col("path")) | F.col("best").startswith(F.concat("path", F.lit("/"))))
    article = F.substring_index(F.substring_index("path", "/", -1), ".", 1).isin("article", "main")
    whole = article | (F.col("below") >= MOST * F.col("total"))
    # an article or main comes first, then the lowest path
    order = F.max(F.when(whole, F.struct(article.alias("a"), F.length("path").alias("n"), "path")))
    return ways.groupBy("host").agg(order.alias("to")).select("host", F.coalesce("to.path", F.lit("")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # written first: the planner then knows the size of this table and joins by broadcast only below its threshold
    winners = cut(consensus(pages).select(F.col("host").alias("_host"), F.col("path").alias("_path")))
    rows = pages.select("page_id", "url", "html").withColumn("_host", host_of(F.col("url"))).join(winners, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.select("page_id", "url", "html", "_path").mapInArrow(run, schema)
