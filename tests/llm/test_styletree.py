import html
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from spanforge.llm import styletree

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def plain_article(markup):
    """The article of the supplied pages, cut with patterns that hold for them alone."""
    body = re.search(r"<article>(.*?)</article>", markup, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b))).strip() for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_against_plain_patterns(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = styletree.query(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r["text"] == plain_article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_without_the_tree_the_result_is_worse(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    off = styletree.Config(least_pages=10**9)
    right = sum(r["text"] == plain_article(r["html"]) for r in styletree.extract(pages, off).join(pages.select("page_id", "html"), "page_id").collect())
    assert right == 0


def test_names_of_classes_and_tags_mean_nothing(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    named = pages.withColumn("html", F.regexp_replace("html", 'class="ad"', 'class="main-article-body"'))
    for a, b in (("nav", "section"), ("footer", "main"), ("article", "aside")):
        named = named.withColumn("html", F.regexp_replace("html", f"<(/?){a}>", f"<$1{b}>"))
    got = {r["page_id"]: r["text"] for r in styletree.extract(named).collect()}
    assert got == {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}


def test_classes_that_differ_from_page_to_page(spark):
    """Their elements are judged by their tags alone."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = F.concat(F.lit('class="x'), F.hex(F.xxhash64("page_id")), F.lit('"'))
    named = pages.withColumn("html", F.replace(F.replace("html", F.lit('class="ad"'), odd), F.lit("<article>"), F.concat(F.lit("<article "), odd, F.lit(">"))))
    got = {r["page_id"]: r["text"] for r in styletree.extract(named).collect()}
    assert got == {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}


class PlainTree(HTMLParser):
    """Nodes of well-formed pages, by their paths as text."""

    def __init__(self, markup):
        super().__init__()
        self.stack, self.styles, self.texts = [("", [])], [], []
        self.feed(markup)
        while self.stack:
            self.styles.append(self.stack.pop())

    def handle_starttag(self, tag, attrs):
        name = ".".join([tag, *sorted((dict(attrs).get("class") or "").split())])
        path, children = self.stack[-1]
        if not children or children[-1] != name:
            children.append(name)
        self.stack.append((f"{path}/{name}", []))

    def handle_endtag(self, tag):
        self.styles.append(self.stack.pop())

    def handle_data(self, data):
        if data.strip():
            self.texts.append((self.stack[-1][0], data.strip()))


def plain_importance(rows, gamma=0.9):
    """(host or None, path with classes) -> (pages, presentation, content, importance), by counting over parsed pages."""
    styles, parts, pages = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, url, markup in rows:
        tree = PlainTree(markup)
        for host in (url.split("/")[2], None):
            styles_here = {(p, tuple(c)) for p, c in tree.styles}
            for p, c in styles_here:
                styles[host, p][c] += 1
            for p in {p for p, _ in tree.texts}:
                pages[host, p] += 1
            for p, s in {(p, s.strip()) for p, t in tree.texts for s in re.split(r"[.!?]", t) if s.strip()}:
                parts[host, p][s] += 1
    out = {}
    for k, m in pages.items():
        n = sum(styles[k].values())
        shown = -sum(x / n * math.log(x / n, n) for x in styles[k].values()) if n > 1 else 1.0
        told = 1 - sum(-sum(1 / x * math.log(1 / x, m) for _ in range(x)) for x in parts[k].values()) / len(parts[k]) if m > 1 else 1.0
        out[k] = (m, shown, told, (1 - gamma) * shown + gamma * told)
    return out


def some_pages(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    pool = [f"{word()} {word()}" for _ in range(4)]
    rows = []
    for i in range(n):
        body = "".join(f"<p>{word()} {word()}. {word()} {word()}</p>" if rng.random() < 0.8 else f"<h2>{word()}</h2>" for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<html><body><ul class='b a'><li>{rng.choice(pool)}</li><li>{rng.choice(pool)}!</li></ul><div class='t{i % 2}'>{body}</div><div>{rng.choice(pool)}. {rng.choice(pool)}</div></body></html>"))
    return rows


def path_key(path):
    found = 1
    for name in path.split("/")[1:]:
        found = styletree.key(name, found) | 1
    return found - (1 << 64) if found >> 63 else found


def test_importance_against_brute_force(spark):
    rows = some_pages(random.Random(1), 60)
    expected = {(h and path_key_host(h), path_key(p)): v for (h, p), v in plain_importance(rows).items()}
    found = {(r["host"], r["node"]): (r["pages"], r["presentation"], r["content"], r["importance"]) for r in styletree.nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert expected.keys() <= found.keys()
    for k, (m, *values) in expected.items():
        assert found[k][0] == m and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(found[k][1:], values)), k
    # what isn't named with classes is the same nodes by tags alone
    assert len(found) > len(expected)


def path_key_host(host):
    found = styletree.key(host)
    return found - (1 << 64) if found >> 63 else found


def page(i, body, extra=""):
    return f"<html><head><title>t{i}</title></head><body><div class=top>Welcome to the site</div>{body}<div id=x1 class=low>All rights kept {extra}</div></body></html>"


def test_recurring_branches_go_and_the_tree_finds_them(spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"<div class=body><h2>Head {i}</h2>Own words {i}<p>More {i} &amp; more</div><div class=box>Read this too</div>")) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3] == "Head 3\n\nOwn words 3\n\nMore 3 & more"


def test_broadcast_and_join_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(pages.limit(3)).unionByName(pages.limit(2).withColumn("page_id", F.lit(None).cast("long")))
    a = Counter((r["page_id"], r["text"]) for r in styletree.extract(pages).collect())
    b = Counter((r["page_id"], r["text"]) for r in styletree.extract(pages, styletree.Config(broadcast_nodes=0)).collect())
    assert a == b and sum(a.values()) == pages.count()


@pytest.mark.parametrize("limit", [0, 200_000])
def test_common_tree_judges_small_sites_whatever_its_size(spark, limit):
    rows = [(i, f"http://h{i}.example/", page(i, f"<div class=body><h2>Head {i}</h2>Own words {i}</div><div class=box>Read this too</div>")) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, SCHEMA), styletree.Config(broadcast_nodes=limit)).collect()}
    assert out == {i: f"Head {i}\n\nOwn words {i}" for i in range(12)}


def test_copies_of_one_page_keep_their_article(spark):
    """A third of all pages, and a whole site, are copies of one page."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    menus = [f"<nav><a>{words(2)}</a></nav>" for _ in range(5)]
    copied = f"<article><h1>{words(5)}</h1><p>{words(9)}. {words(9)}</p><p>{words(7)}</p></article>"
    rows = [(i, f"http://c{i % 2}.example/", f"<body>{rng.choice(menus)}{copied}</body>") for i in range(60)]
    rows += [(100 + i, f"http://d{i % 7}.example/", f"<body>{rng.choice(menus)}<article><h1>{words(5)}</h1><p>{words(9)}. {words(9)}</p></article></body>") for i in range(120)]
    out = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    tree = lambda x: "\n\n".join(t for p, t in PlainTree(x).texts if "nav" not in p)
    assert out == {i: tree(x) for i, _, x in rows}


def whole(markup):
    return styletree.text_of(styletree.Page(markup), lambda node: None)


@pytest.mark.parametrize(
    "markup,text",
    [
        ("", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("<p>a<p>b<b>c</b>d<br>e", "a\n\nbcd e"),
        ("<ul><li>x<li>y</ul>", "x\n\ny"),
        ("<script>var a='<p>no</p>'</script><p>yes", "yes"),
        ("<style>p{}", ""),
        ("<head><title>no</title><p>yes", "yes"),
        ("<p>1 < 2 and <unfinished", "1 < 2 and"),
        ("<!-- no --><p>yes<!-- no", "yes"),
        ("<p>a&nbsp;&#8212;\t b</p>", "a — b"),
        ("<div class='content-with-sidebar'>a</div><section class='related-work'>b</section><div title='a hidden gem'>c</div>", "a\n\nb\n\nc"),
        ("<main>yes<select><option>no<option>no</select><button>no</button></main>", "yes"),
        ("<p title='a>b'>x</p></div></div>", "x"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<p><button><p>no</button>x<p>y", "x\n\ny"),
    ],
)
def test_markup(markup, text):
    assert whole(markup) == text


@pytest.mark.parametrize("markup", ["<div>" * 100_000 + "deep", "<x-y>" * 50_000 + "<p>" * 50_000 + "deep", "<p>" + "<center><x>" * 50_000 + "deep", "<ul><li>" * 50_000 + "deep" + "</ul>" * 50_000, "</div>" * 100_000 + "deep"])
def test_depth_costs_little(markup):
    assert whole(markup) == "deep"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://[bad", "<p>x"), (3, "http://[bad", "<p>x"), (None, "http://a.example", "<p>" + "long " * 50_000), (4, "http://a.example", "<div>" * 20_000 + "deep")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash"))
    out = sorted((r["page_id"] or 0, len(r["text"])) for r in styletree.extract(df).collect())
    assert out == [(0, 249_999), (1, 0), (2, 0), (3, 1), (3, 1), (4, 4)]
    assert styletree.extract(df.limit(0)).count() == 0
