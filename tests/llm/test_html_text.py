import json
import random

import pytest
from pyspark.sql.functions import xxhash64

from repograph.llm import dom, html_text
from repograph.llm.dom import Group, grouped, parse
from repograph.llm.html_text import extract_main_text, host_of, host_wrappers, induce, main_text
from tests.llm.helpers import words

CHROME = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
          "<header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>A {n}</a></li></ul></nav>"
          "<div class='cookie-notice'>We use cookies {n}</div><div class=\"ad\">Buy {n}</div>")
TAIL = ("<aside>Also {n}</aside><section id='comments'><article><p>First! {n}</p></article></section>"
        "<form><label>Mail</label><button>Send</button></form><footer>&copy; host {n}</footer></body></html>")


def paragraphs(n, seed):
    return [words(5 + (seed + i) % 7, 31 * seed + i) for i in range(n)]


def marked_page(n):
    body = paragraphs(3, n)
    html = CHROME.replace("{n}", str(n)) + "<main><article><header><h1>T" + str(n) + " &amp; co</h1></header>" + \
        "".join(f"<p>{p}" for p in body) + f"<div class='share'>Share {n}</div></article></main>" + TAIL.replace("{n}", str(n))
    return html, "\n".join([f"T{n} & co", *body])


def bare_page(n):
    """No element or class says what is what: only the pages of the host together do."""
    body = paragraphs(3, 100 + n)
    html = ("<div class=x1><div>The Daily</div><div><a href=/>Home</a> <a href=/n>News</a></div></div>"
            f"<div class=x2><h2>T{n}</h2>" + "".join(f"<p>{p}</p>" for p in body) +
            "<p>Follow us every day</p></div><div class=x3><p>All rights stay with us</p></div>")
    return html, "\n".join([f"T{n}", *body])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "c") for r in rows],
                                 "page_id long, url string, html string, host string, id int, wrapper string")


def test_truth_over_hosts(spark):
    rows, truth = [], {}
    for make, host, start in ((marked_page, "Marked.example.org", 0), (bare_page, "bare.example.org:8080", 100)):
        for i in range(30):
            html, truth[start + i] = make(i)
            rows.append((start + i, f"https://{host}/p/{i}", html))
    for k, make in enumerate((marked_page, lambda n: ("<div>only <i>one</i>\n page</div>", "only one page"))):
        html, truth[200 + k] = make(7)
        rows.append((200 + k, f"http://single{k}.example.org", html))
    found = {r["page_id"]: r for r in extract_main_text(frame(spark, rows).repartition(5)).collect()}
    assert {i: r["text"] for i, r in found.items()} == truth
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_copies_and_shared_passages_do_not_become_template(spark):
    r = random.Random(1)
    shared = words(60, 5)
    rows, truth = [], {}
    for i in range(60):                    # near copies of one page, two paragraphs of eight differ
        body = [shared, *paragraphs(5, 1), words(9, 900 + i), words(9, 990 + i)]
        rows.append((i, "http://h/", "<article>" + "".join(f"<p>{p}</p>" for p in body) + "</article>"))
        truth[i] = "\n".join(body)
    for i in range(60, 120):               # a passage in every third page of the host
        body = [*paragraphs(4, 50 + i), *([shared] if r.random() < 0.33 else [])]
        rows.append((i, "http://h/", "<article>" + "".join(f"<p>{p}</p>" for p in body) + "</article>"))
        truth[i] = "\n".join(body)
    rows += [(i, "http://same/", "<div><p>equal</p></div>") for i in range(120, 160)]
    truth.update({i: "equal" for i in range(120, 160)})
    found = extract_main_text(frame(spark, rows)).collect()
    assert {x["page_id"]: x["text"] for x in found} == truth


def test_constant_text_in_articles_needs_many_pages():
    pages = [f"<article><p>{words(9, i)}</p><p>Follow us</p></article>" for i in range(12)]
    assert induce(pages[:7]) is None
    wrapper = json.loads(induce(pages))
    assert main_text(pages[0], wrapper) == words(9, 0)
    other = "<article><p>x</p><ul><li>Follow us</li></ul></article>"      # not at the template's node
    assert main_text(other, wrapper) == "x\nFollow us"


def test_all_pages_of_a_host_take_part(spark, monkeypatch):
    """A line of a third of the pages is no template, whichever pages a sample would take; one of
    two thirds is; also with more layouts than one task merges."""
    monkeypatch.setattr(html_text, "FAN", 2)
    rows, truth = [], {}
    for seed in range(12):
        r = random.Random(seed)
        some, many = r.sample(range(24), 8), r.sample(range(24), 16)
        for i in range(24):
            body = paragraphs(3, 1000 * seed + i) + (["Shared by some"] if i in some else [])
            html = f"<div>{'<h2></h2><ul></ul>' * (i % 5)}</div><div>" + "".join(f"<p>{p}</p>" for p in body) + "</div>"
            html += "<h3>Shared by many</h3>" if i in many else "<h3></h3>"
            rows.append((100 * seed + i, f"http://host{seed}/", html))
            truth[100 * seed + i] = "\n".join(body)
    assert {x["page_id"]: x["text"] for x in extract_main_text(frame(spark, rows)).collect()} == truth

def test_wrappers_by_keys_equal_those_of_a_host_in_memory(spark):
    """Near copies of pages and of each other, equal pages, marked and unmarked articles."""
    r = random.Random(8)
    of_host: dict = {}
    for host in range(6):
        texts = [words(r.randrange(3, 30), 77 * host + i) for i in range(25)]
        for _ in range(60):
            tag = r.choice(["article", "div", "div"])
            page = "".join(f"<{t}>{r.choice(texts)}</{t}>" for t in r.choices(["p", "h2", "li"], k=r.randrange(1, 9)))
            of_host.setdefault(f"h{host}", []).append(
                f"<div>Top</div><{tag}>{page}<p>Below</p></{tag}>" + ("<main>m</main>" if r.random() < 0.1 else ""))
    rows = [(i, f"http://{h}/", p) for h, pages in of_host.items() for i, p in enumerate(pages)]
    df = frame(spark, rows)
    in_order: dict = {}
    for x in df.select(host_of(df["url"]).alias("host"), "html").orderBy(xxhash64("html")).collect():
        in_order.setdefault(x["host"], []).append(x["html"])
    found = dict(host_wrappers(df).collect())
    assert {h: places(w) for h, w in found.items()} == {
        h: places(w) for h, pages in in_order.items() if (w := induce(pages))}


def places(wrapper):
    """Template texts with the labels on the way to them."""
    out = set()

    def walk(kind, way, node):
        out.update((kind, way, t) for t in node[1])
        for c in node[2]:
            walk(kind, (*way, c[0]), c)
    for kind, tree in enumerate(json.loads(wrapper)):
        if tree:
            walk(kind, (tree[0],), tree)
    return out


def test_edge_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>word &lt;1&gt;</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "no url", " \n "), (None, "http://x/", "<p>a</p>"),
            (4, "http://x/", "<p>a</p>"), (4, "http://x/", "<p>a</p>"), (4, "http://y/", "<p>b</p>"),
            (5, None, deep), (6, "http://x/", long), (7, "http://[", "plain < text &eacute;&nbsp;x"),
            (8, "http://z/", "<article></article><p>beside</p>")]
    found = sorted(((r["page_id"], r["url"], r["text"]) for r in extract_main_text(frame(spark, rows)).collect()),
                   key=str)
    long_text = "\n".join(["word <1>"] * 50_000)
    assert found == sorted([(1, None, ""), (2, "", ""), (3, "no url", ""), (None, "http://x/", "a"),
                            (4, "http://x/", "a"), (4, "http://x/", "a"), (4, "http://y/", "b"), (5, None, "deep"),
                            (6, "http://x/", long_text), (7, "http://[", "plain < text é x"),
                            (8, "http://z/", "beside")], key=str)
    assert extract_main_text(frame(spark, [])).collect() == []


@pytest.mark.parametrize("html,text", [
    ("<p>One<p>Two<b>bold<p>three", "One\nTwobold\nthree"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p>x<script>1 < 2</script>y <!-- <p>no</p> --> z<br>w</p>", "xy z w"),
    ("<p>a <span class='ad'>buy <div>now</div></span>b</p>", "a b"),
    ("<span hidden>x</span>y<span class=ad>unclosed</p><p>z", "y"),
    ("<p>a <span class=ad>unclosed</p><p>z</p>", "a\nz"),
    ("<a title='1>0' href=x>in</a> text longer than the link", "in text longer than the link"),
    ("<form><h1>Whole page in a form</h1><p>t</p></form>", "Whole page in a form\nt"),
    ("<header><h1>Title</h1><nav>n</nav></header><p>t</p>", "Title\nt"),
    ("<div class='sidebar'><p>s</p></div><div role=main><p>m</p></div>", "m"),
    ("<article><p>a</p><article>reply</article><footer>f</footer></article>", "a"),
    ("<div class=ad><article>unclosed advert</article>", "unclosed advert"),
    ("<p>&amp;lt; &#65;&am; &unknown;</p>", "&lt; A&am; &unknown;"),
    ("a <b", "a <b"), ("<!-- open", "<!-- open"), ("", ""),
])
def test_forms(html, text):
    assert main_text(html) == text


def test_hosts(spark):
    urls = ["HTTP://User@Host.org:80/x?y", "https://a.b", "//c", None, "", "ftp://[::1]:21/", "http://h\\x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_of(df["u"])).collect()] == ["host.org", "a.b", "", "", "", "[::1]", "h"]


def brute_matching(a, b):
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_matching(x[0], y[0]))
    return 1 + best(a.children, b.children)


def test_simple_tree_matching_equals_the_recursive_definition():
    r = random.Random(3)

    def tree(depth):
        return Group(r.choice("ab"), {}, [tree(depth - 1) for _ in range(r.randrange(4 if depth else 1))])
    for _ in range(60):
        a, b = tree(3), tree(3)
        b.label = a.label
        memo = {}
        assert dom._matching(a, b, memo) == brute_matching(a, b)
        assert sum(brute_matching(a.children[i], b.children[j]) for i, j in dom._aligned(a, b, memo)) + 1 == \
            brute_matching(a, b)


def test_size_of_the_matched_tree_follows_the_layout():
    many = grouped([parse("<div>" + "<p>x</p>" * 5000 + "</div>")])
    assert len(many.children[0].children) == 1
    mixed = grouped([parse("<div>" + "<p>x</p><h2>y</h2>" * 5000 + "</div>")])
    assert len(mixed.children[0].children) == 2
