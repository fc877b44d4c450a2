from driftline.llm import html_text as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>Bold<br>line<p>Two\n  spaces &lt;b&gt; &eacute;<ul><li>one<li>two</ul><form>no</form><section class="comments"><p>me too</p></section></article>
<aside>Side</aside><div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def blocks(page, template=frozenset()):
    return m.parse(page, template)[1]


def test_article():
    assert blocks(PAGE) == ["Title & more", "Bold line", "Two spaces <b> é", "one", "two"]


def test_broken_markup():
    assert blocks("a < b <p>c <!-- never closed") == ["a < b", "c"]
    assert blocks("</div><p title='x>y'>q</b></p></body>z") == ["q", "z"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("<script>if (a</b) x('</p>')</script>after") == ["after"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("<p") == ["<p"]
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert blocks("<p title=\"never closed " * 300)[:1] != ["x"]


def test_template_is_deleted_but_articles_stay(spark, tmp_path):
    rows = [(i, f"http://Host.test/{i}", f"<div><span>Welcome to our site</span></div><div><p>Story {i} words</p></div>", "x", 1) for i in range(30)]
    rows += [(100 + i, "http://twin.test/", "<div>Bar</div><article><p>Same article</p></article>", "x", 1) for i in range(30)]
    rows += [(200, None, None, "x", 1), (201, "http://few.test/", "<p>Alone</p>", None, None), (None, "x", "<p>no id</p>", "x", 1)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, template long").write.parquet(path)
    found = m.main_text(spark.read.parquet(path)).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert all(texts[i] == f"Story {i} words" for i in range(30))
    assert all(texts[100 + i] == "Same article" for i in range(30))
    assert (texts[200], texts[201], texts[None]) == ("", "Alone", "no id")
    assert {r.url for r in found if r.page_id == 200} == {None}


def test_template_inside_marked_content(spark, tmp_path):
    def page(i):
        story = f"<h1>Head {i}</h1><p>Story {i} <b>Paris</b> words</p><div><p>Read us on every device</p></div><ul><li>common item<li>item {i}</ul>"
        return f"<main>{story}</main>" if i % 2 else f"<article>{story}</article>"

    copy = "<article><h1>Copied</h1><p>First of it</p><p>Second of it</p><p>Third {}</p></article>"
    long = "A sentence that all copies of this article have. " * 9
    rows = [(i, f"http://own.test/{i}", page(i)) for i in range(30)] + [(100 + i, "http://same.test/", copy.format("")) for i in range(30)]
    rows += [(200 + i, "http://near.test/", f"<article><p>{long}</p><p>Edit {i}</p></article>") for i in range(30)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    texts = {r.page_id: r.text for r in m.main_text(spark.read.parquet(path)).collect()}
    assert all(texts[i] == f"Head {i}\n\nStory {i} Paris words\n\ncommon item\n\nitem {i}" for i in range(30))
    assert all(texts[100 + i] == "Copied\n\nFirst of it\n\nSecond of it\n\nThird" for i in range(30))
    assert all(texts[200 + i] == f"{long.strip()}\n\nEdit {i}" for i in range(30))


def test_template_of_a_section(spark, tmp_path):
    rows = [(i, f"http://big.test/{'news' if i < 12 else 'shop'}/{i}", f"<div>{'Editor of the day' if i < 12 else i}</div><p>Text {i}</p>") for i in range(120)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    texts = {r.page_id: r.text for r in m.main_text(spark.read.parquet(path)).collect()}
    assert all(texts[i] == f"Text {i}" for i in range(12)) and texts[12] == "12\n\nText 12"
    assert [m.section_of(u) for u in ("http://h/a/b?x", "http://h/a", "http://h/a/", "", "http://h//a//b/c")] == ["a", "", "", "", "a"]


def test_small_article_beside_body_text():
    body, teaser = "<p>Body text of the page in some length</p>", "<article><p>Teaser</p></article>"
    both = ["Body text of the page in some length", "Teaser"]
    assert blocks(f"<div>Bar</div><main>{body}{teaser}</main>") == blocks(f"<div>{body}</div>{teaser}") == both
    assert blocks(f"<p>Bar</p><article>{body}</article>") == both[:1]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path)
    assert m.main_text(spark.read.parquet(path)).count() == 0


def test_names_that_only_mention_a_word():
    body = "<p>Body text of some length, with words</p>"
    for name in ("content with-sidebar", "post no-comments has-share", "related-work", "ad-free", "notice-of-motion", "commentaries-on-law", "navigating"):
        assert blocks(f"<div class='{name}'>{body}</div>") == blocks(f"<article class='{name}'>{body}</article>") == [body[3:-4]], name
    for name in ("sidebar", "main-nav", "siteNav", "sidebar-left", "cookie-banner", "post-share", "google_ads_iframe_1", "related-posts", "comments-area", "Comments", "ad300x250 ad"):
        assert blocks(f"<div class='{name}'><p>x</p></div>{body}") == [body[3:-4]], name
    assert [m.says(n) for n in ("page-header", "entry-header", "comment-list", "share-buttons", "", "-", "7")] == ["header", "", "comments", "out", "", "", ""]


def test_names_do_not_take_most_of_a_page():
    long, short = "<p>" + "long text " * 20 + "</p>", "<p>short</p>"
    text = ("long text " * 20).strip()
    assert blocks(f"<div class='widget'>{long}</div>{short}") == [text, "short"]
    assert blocks(f"<div class='widget'>{short}</div>{long}") == [text]
    assert blocks(f"<div class='comments'>{long}</div>{short}") == ["short"]  # comments are none of the text, however long
    assert blocks(f"<div class='widget'>{long}</div><article>{short}</article>") == ["short"]  # marked text needs no help
    assert blocks(f"<div class='widget'><div class='menu'>x</div>{long}</div>") == [text]


def test_articles_in_articles():
    reader = "<article><p>me too</p></article>"
    assert blocks(f"<article><h1>Head</h1><p>The body of it</p>{reader * 3}</article>") == ["Head", "The body of it"]
    assert blocks(f"<article><h1>List</h1>{'<article><p>A part of its own with text</p></article>' * 2}</article>") == ["List"] + ["A part of its own with text"] * 2
    deep = "<article>" * 1500 + "<p>deep</p>" + "</article>" * 1500
    assert blocks(deep) == ["deep"]


class Plain:
    """A plain reading of well-formed pages: a tree by the standard parser, elements left out by tag or name, blocks in order."""

    def __init__(self, page):
        from html.parser import HTMLParser

        outer = self
        self.root, self.stack = ["html", "", []], []
        self.stack.append(self.root)

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = [tag, " ".join(v or "" for k, v in attrs if k in ("class", "id")), []]
                outer.stack[-1][2].append(node)
                if tag not in m.VOID:
                    outer.stack.append(node)

            def handle_endtag(self, tag):
                outer.stack.pop()

            def handle_data(self, data):
                outer.stack[-1][2].append(data)

        Reader(convert_charrefs=True).feed(page)

    def blocks(self):
        out, run = [], []

        def end():
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

        def walk(node):
            tag, names, children = node
            if tag in m.BLOCK:
                end()
            if tag in m.OUT or tag == "header" or any(m.says(n) for n in names.split()):
                return
            for c in children:
                run.append(c) if isinstance(c, str) else run.append(" ") if c[0] == "br" else walk(c)
            if tag in m.BLOCK:
                end()

        found = []

        def search(node, tag):
            for c in node[2]:
                if not isinstance(c, str):
                    found.append(c) if c[0] == tag else search(c, tag)

        search(self.root, "article")
        for node in found or [self.root]:
            walk(node)
        return out


def test_against_a_plain_parser():
    import random

    rng = random.Random(11)
    words = "alpha beta gamma &amp; &eacute; &#65; delta".split()

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice(["", "\n ", "  "])

    def element(depth):
        kind = rng.choice(["p", "div", "b", "ul", "text", "text", "nav", "named", "br", "script", "section", "table"])
        if depth > 3 or kind == "text":
            return text()
        inner = lambda: "".join(element(depth + 1) for _ in range(rng.randint(1, 3)))
        if kind == "p":
            return f"<p>{text()}<i>{text()}</i></p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(3)) + "</ul>"
        if kind == "table":
            return f"<table><tbody><tr><td>{text()}</td><td>{text()}</td></tr></tbody></table>"
        if kind == "named":
            return f"<div class='{rng.choice(['comments', 'box', 'content-wide'])}'>{inner()}</div>"
        if kind == "br":
            return "<br>"
        if kind == "script":
            return "<script>if (a) { b() }</script>"
        return f"<{kind}>{inner()}</{kind}>"

    for i in range(400):
        content = "".join(element(0) for _ in range(rng.randint(1, 6)))
        page = f"<div>{content}</div>" if i % 2 else f"<nav>Menu</nav><article>{content}</article><footer>Foot</footer>"
        assert blocks(page) == Plain(page).blocks(), page


def test_very_long_page_and_clashing_columns(spark, tmp_path):
    import time

    long = "<div><p>word " * 40_000
    began = time.process_time()
    assert len(blocks(long)) == 40_000
    assert len(blocks("<p>a</p>" * 200_000)) == 200_000 and time.process_time() - began < 60
    rows = [(1, "http://h/a", "<article><p>x</p></article>", 5, "s", "p"), (1, "http://h/a", "<article><p>x</p></article>", 5, "s", "p")]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string, salt int, section string, pages string").write.parquet(path)
    assert [(r.page_id, r.text) for r in m.main_text(spark.read.parquet(path)).collect()] == [(1, "x")] * 2
