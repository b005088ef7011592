import html
import random
import re
import time

import pytest

from loomwright.llm.html_extract import DEPTH, blocks, consensus, extract, extract_pages, worths
from loomwright.llm.url_filter import domain_of, judge

PAGES = [
    ("", ""),
    (None, ""),
    ("<nav>menu</nav><footer>f</footer>", ""),
    ("<p>a", "a"),
    ('<div class="content"><p>Hello <b>wor</b>ld&amp;x<br>y</p><div class="comments"><p>bad</p></div></div>', "Hello world&x y"),
    ("<body><nav>m</nav><main><header><h1>T</h1></header><p>abc def<p>x < y and z</main><footer>f</footer>", "T abc def x < y and z"),
    ('<script>var x="</p>"</script><div><p>t<!-- c --> u</div><!-- open', "t u"),
    ('<div id="main"><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div><aside>q</aside>', "one two a b"),
    ('<div class="cookie-notice"><p>we use cookies, a lot of them, on every page</p></div><article><p>short &lt;p&gt; text</p></article>', "short <p> text"),
    ('<body><p>menu text</p><article><div class="intro"><p>first words</p></div><div class="body"><p>the long rest of the text</p></div></article>', "first words the long rest of the text"),
    ('<div class="a"><div class="intro"><p>first words here</p></div><div class="text"><p>the long rest of the text</p></div></div>', "first words here the long rest of the text"),
    ('<p title="a > b">x</p><p title=\'it"s\'>y</p><svg>open<p>z</p>', "x y open z"),
    ("<article><p>kept</p><form><p>name</p></form><style>p{}</style></article>", "kept"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_extraction(page, text):
    assert extract(page, None) == text


def test_host_consensus_beats_a_page_of_its_own_mind(spark):
    usual = '<div class="post"><p>{}</p></div><div class="box"><p>teaser</p></div>'
    rows = [(i, f"http://H.example/{i}", usual.format("long text " * 20)) for i in range(5)]
    rows += [(9, "http://h.example/9", '<div class="post"><p>tiny</p></div><div class="box"><p>a teaser longer than the post</p></div>'), (10, None, "<p>x</p>"), (11, "http://h.example/11", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["host"]: r["path"] for r in consensus(df).collect()}["h.example"] == "/div.post"
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert got[9]["text"] == "tiny" and got[10]["text"] == "x" and got[11]["text"] == "" and got[11]["n_chars"] == 0
    assert extract_pages(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for r in got:
        title = " ".join(html.unescape(re.search("<h1>(.*?)</h1>", pages[r["page_id"]], re.S)[1]).split())
        assert r["text"].startswith(title + " ") and r["text"][len(title) + 1 :] in docs
    assert len(got) == len(pages)


def test_rules_and_reputation(spark):
    urls = ["http://A.NET/x", "http://m.example.net/en/1", "http://example.com/de/2", "https://x.org/fr/", "http://x.org/en/", "http://a.net", "no scheme", None, "ftp://x.com?u=http://b.net/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.com/{i}") for i in range(40)] + [(200 + i, f"http://good.com/{i}") for i in range(40)]
    labels = [(100 + i, 0, 1) for i in range(38)] + [(200 + i, 1, 0) for i in range(38)] + [(0, None, None)]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", "block", "allow"]
    assert (got[6]["host"], got[6]["path"], got[8]["host"], got[8]["path"]) == ("", "", "x.com", "")
    assert {got[100 + i]["verdict"] for i in range(40)} == {"block"} and {got[200 + i]["verdict"] for i in range(40)} == {"allow"}
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge(empty, none).count() == 0
    assert judge(spark.createDataFrame(pages, "page_id long, url string"), none).count() == len(pages)


def test_long_pages_take_linear_time():
    began = time.time()
    assert blocks("<a '" * 250_000) == []
    assert blocks("<a \"'>x" * 100_000)
    assert extract("<div>" * 100_000 + "<p>deep</p>" + "</span></section>" * 100_000, None) == "deep"
    assert len(extract("<p>word</p>" * 100_000, None)) == 5 * 100_000 - 1
    assert time.time() - began < 20
    assert max(p.count("/") for p, *_ in blocks("<div>" * 1000 + "x")) == DEPTH


def plain_consensus(pages):
    """Sums over all pages of a host in one dictionary, and the climb by its definition."""
    hosts = {}
    for _, url, text in pages:
        host = re.sub("[/?#].*", "", (url or "").partition("://")[2]).lower()
        score, below = worths(blocks(text or ""))
        mine = hosts.setdefault(host, ({}, {}))
        for have, new, times in ((mine[0], score, 2), (mine[1], below, 1)):
            for k, v in new.items():
                have[k] = have.get(k, 0) + max(0, round(v * times))
    out = {}
    for host, (score, below) in hosts.items():
        if not any(score.values()):
            continue
        path = min((-v, k) for k, v in score.items() if v > 0)[1]
        steps = [path[: m.start()] for m in re.finditer("/", path)][::-1]
        ways = [path, *(steps or ([""] if path else []))]
        inside = [w for w in ways if re.search(r"(?:^|/)(?:article|main)(?:[.][^/]*)?$", w)]
        out[host] = inside[0] if inside else next(w for w in [*ways, ""] if w == "" or below.get(w, 0) >= 0.9 * below.get("", 0))
    return out


def test_consensus_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            tag, name = r.choice(["div", "section", "article", "main"]), r.choice(["", "a", "b", "side", "c1"])
            inner = "".join(f"<{t}><p>{'word ' * r.randint(0, 30)}</p></{t}>" for t in r.choices(["div", "p", "section class=x", "article"], k=r.randint(1, 3)))
            parts.append(f'<{tag} class="{name}">{inner.replace("</section class=x>", "</section>")}</{tag}>')
        rows.append((i, r.choice(["http://a.com/", "http://b.org/x", "https://c.net/?q", None, "http://d.de/1"]), r.choice(["".join(parts), "".join(parts), None])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {x["host"]: x["path"] for x in consensus(df).collect()} == plain_consensus(rows)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, None, 1, 2), (1, "http://a.b/c", "<p>x", 3, 4), (1, "http://a.b/c", "<p>x", 3, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, host int")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extract_pages(df).collect())
    assert got == [(0, ""), (1, "x"), (1, "x")]


def test_url_filter_takes_odd_rows_and_clashing_names(spark):
    url = "http://a.com.tr/" + "x" * 200_000
    rows = [(None, None, "h", "r"), (1, url, "h", "r"), (1, url, "h", "r"), (2, "http://A.net/", "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _standing string")
    labels = spark.createDataFrame([(1, 0, None, "v"), (1, 0, None, "v"), (None, 1, 1, "v")], "doc_id long, quality int, toxic int, verdict string")
    got = sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"]) for r in judge(pages, labels).collect())
    assert got == [(0, "", 0, None), (1, "a.com.tr", 200_001, None), (1, "a.com.tr", 200_001, None), (2, "a.net", 1, "net/")]
    known = spark.createDataFrame([("a.com.tr",), ("b.x.com.tr",), ("c.co",)], "h string")
    assert [r[0] for r in known.select(domain_of("h")).collect()] == ["a.com.tr", "x.com.tr", "c.co"]
