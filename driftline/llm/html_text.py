"""Main text of web pages by site template removal.

Elements of a page are hashed with all that is below them. Spark counts on how many pages of a host
each subtree stands, combined map-side; subtrees that recur on at least min_pages pages and a share
min_share of the host's pages, or of those of a section (the first segment of the path), are the
site's template, and a second pass over the pages deletes them, inside the content that a page marks
itself (article, main) too. What is protected there: the marked element itself; copies, as a subtree
counts once for each different marked element that it stands in, and as one that would lose more
than COPIED of its text keeps all of it; and the insides of blocks, as inline elements, list items
and parts of tables have no hash of their own there.

Elements whose tag says menu, footer, sidebar, form, script or style, or whose role does, are left
out whatever they hold, as they often differ from page to page. So are those with a name (a word of
class or id) that says menu, header, footer, sidebar, notice, advert, form or comments: a name is
such a word by itself or beside words of place and form (`main-nav`, `sidebar-left`), but not one
that only mentions it (`with-sidebar`, `no-comments`, `related-work`). On a page without marked
text, one that a name alone leaves out comes back if it holds more than MOST of the page's text,
unless its name says comments. An article within an article is a comment on it, if the outer one
has as much text of its own as the longest inner one.

Of what is left the articles are the text, if they hold at least MARKED of all that is marked (of
the page, without a main); else all that is marked is, or the page.

Text: character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by a blank line; nothing else is dropped. A br is white space within its block, and
a block that is left out ends the text before it.

Plan. Templates are a few hashes a host or section (at most 1 / min_share times the mean number of
subtrees of a page); they are written, so that their size is known when Spark picks the join, and
each host's pages are dealt over SALTS keys, so that a hot host's pages are read by as many tasks.

Hosts of fewer than min_pages pages have no template, as too few pages tell what recurs; marks, tags
and names alone decide there.

Defined results: a null page or url counts as empty; text is empty if nothing is left; very long
pages are read whole, in time in proportion. Repeated rows are pages of their own, null page_ids
stay. Tags left open, stray ends and unclosed comments are read as browsers mostly do. An empty
table gives an empty result. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import materialise, table

MIN_PAGES, MIN_SHARE = 10, 0.2
COPIED, MARKED, MOST, SALTS = 0.8, 0.5, 0.5, 16

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUT = RAW | {"head", "nav", "footer", "aside", "form", "dialog", "menu", "svg", "math", "canvas", "object", "audio", "video", "button", "select", "option", "datalist", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of names. A name says one of them if its other words only say where or what kind of box it is.
COMMENTS = set("comment comments commentlist commentary disqus replies reply respond".split())
SAYS_OUT = COMMENTS | set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups "
    "modal modals overlay overlays newsletter newsletters subscribe subscription sidebar sidebars menu menus nav navbar navbars navigation breadcrumb breadcrumbs footer footers masthead topbar toolbar "
    "share sharing social related recommended widget widgets login signup skip".split()
)
SAYS_HEADER = {"header", "siteheader", "pageheader", "topheader"}
AROUND = set(
    "site page post entry article blog global main top bottom left right primary secondary first second third inner outer upper lower sticky fixed mobile desktop header footer "
    "area bar block body box button buttons card container content form group holder icons inside inner item items layer leaderboard link links list message module panel popup row section slot space "
    "stories posts articles news reading text title toggle top unit view widget wrap wrapper zone count counter thread threads feed bottom google gpt dfp iframe id policy law eu the of and".split()
)
_SPLIT = re.compile(r"[_\W]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
#: A start tag ends an open element of these, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"body"}),
}
#: Blocks that are pieces of a list or a table.
PIECES = {"caption", "dd", "dt", "legend", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
_P = {"p"}
P_SCOPE = {"td", "th", "caption", "button", "object", "html", "table"}


@lru_cache(1 << 16)
def says(name: str) -> str:
    """What a word of a class or id says: "comments", "out", "header" or nothing."""
    words = [w.lower() for w in _SPLIT.split(name) if w and not w[0].isdigit()]
    found = [w for w in words if w in SAYS_OUT]
    if found and all(w in SAYS_OUT or w in AROUND for w in words):
        return "comments" if COMMENTS & set(found) else "out"
    if words and words[-1] in SAYS_HEADER and all(w in SAYS_HEADER or w in ("site", "page", "top", "main", "global") for w in words):
        return "header"
    return ""


class _Element:
    __slots__ = ("cut", "holds_marked", "inner", "marked", "named", "nested", "out", "parts", "seen", "set_aside", "tag")

    def __init__(self, tag: str, out: bool, marked: int, start: str, named: str = "", set_aside: bool = False):
        self.tag, self.out, self.marked = tag, out, marked
        #: A hash of the start tag, the text and the hashes of the elements below.
        self.seen = xxhash.xxh64(start)
        #: What the element's own names say, and whether it lies within an element that such a name sets aside.
        self.named, self.set_aside = named, set_aside
        self.holds_marked = False
        self.parts: list = []
        #: Of articles: the places of articles within, their parts and how much text these hold.
        self.nested: list[tuple[list, list, int]] = []
        #: Of marked elements: the hashes below, and the parts of those that are template.
        self.inner: list[int] = []
        self.cut: list[list] = []


def _blocks(parts: list) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []
    waiting = [iter((None, parts, None))]
    while waiting:
        for x in waiting[-1]:
            if x is None:
                if block := " ".join("".join(run).split()):
                    blocks.append(block)
                run = []
            elif isinstance(x, list):
                waiting.append(iter(x))
                break
            else:
                run.append(x)
        else:
            waiting.pop()
    return blocks


def _size(blocks: list[str]) -> int:
    return sum(map(len, blocks))


def _leaves_out(tag: str, attributes: str, marked: int) -> tuple[bool, str]:
    """Whether the element goes whatever it holds, and what its names say otherwise."""
    if tag in OUT or tag == "header" and not marked:
        return True, ""
    said = ""
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True, ""
        if name in ("class", "id") and tag not in ("html", "body", "main", "h1"):
            for word in value.split():
                now = says(word)
                if now and (now != "header" or not marked) and said != "comments":
                    said = now
    return False, said


def parse(page: str, template: frozenset[int] = frozenset(), read: bool = True) -> tuple[dict[int, int | None], list[str]]:
    """The subtrees' hashes, and the text blocks that are left without those of the template (none unless read).

    A subtree is hashed as it is written, but for its end tags; with its hash comes
    the hash of the marked element that it stands in, or None if it stands beside them. Marked
    elements, what encloses them, and what is left out anyway have no hash.
    """
    stack = [_Element("", False, 0, "")]
    open_tags: dict[str, int] = defaultdict(int)
    aside: list[tuple[list, list]] = []
    hashes: dict[int, int | None] = {}
    articles: list[list] = []
    tops: list[list] = []
    roots: list[_Element] = []
    mains = False

    def close() -> None:
        e = stack.pop()
        up = stack[-1]
        open_tags[e.tag] -= 1
        own = e.seen.intdigest()
        up.seen.update(own.to_bytes(8, "little"))
        own -= 1 << 63
        if e.named:
            place: list = []
            up.parts += (None, place, None) if e.tag in BLOCK else (place,)
            if e.named != "comments" and not e.marked:
                aside.append((place, e.parts))
            return
        if roots and e is roots[-1]:
            roots.pop()
            up.holds_marked = True
            size = 0
            if read and (e.tag == "article" or e.nested):
                size = _size(_blocks(e.parts))
                if e.nested and size < max(n for _, _, n in e.nested):
                    for place, parts, n in e.nested:
                        place += (None, parts, None)
                        size += n
            for h in e.inner:
                hashes.setdefault(h, own)
            if e.cut and read:
                whole, kept = _size(_blocks(e.parts)), list(map(list, e.cut))
                for parts in e.cut:
                    parts.clear()
                if _size(_blocks(e.parts)) < (1 - COPIED) * whole:
                    for parts, was in zip(e.cut, kept, strict=True):
                        parts += was
            if not up.marked:
                tops.append(e.parts)
            if e.tag == "article":
                if outer := next((r for r in reversed(roots) if r.tag == "article"), None):
                    outer.nested.append((place := [], e.parts, size))
                    up.parts.append(place)
                    return
                articles.append(e.parts)
        elif e.holds_marked:
            up.holds_marked = True
        elif not e.out and not e.set_aside:
            if not e.marked:
                hashes[own] = None
                if own in template:
                    if e.tag in BLOCK:
                        up.parts.append(None)
                    return
            elif e.tag in BLOCK and e.tag not in PIECES:
                roots[-1].inner.append(own)
                if own in template:
                    roots[-1].cut.append(e.parts)
        if not e.out:
            if e.tag in BLOCK:
                up.parts += (None, e.parts, None)
            else:
                up.parts.append(e.parts)
        elif e.tag in BLOCK and not up.out:
            up.parts.append(None)

    def end_open(tags: set[str], scope: set[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in tags:
                while len(stack) > i:
                    close()
                return
            if tag in scope:
                return

    def say(text: str) -> None:
        e = stack[-1]
        e.seen.update(text)
        if not e.out:
            e.parts.append(html.unescape(text) if "&" in text else text)

    at, search = 0, TOKEN.search
    while token := search(page, at):
        start, end = token.span()
        if start > at:
            say(page[at:start])
        at = end
        ending, tag, attributes, ending2, tag2, attributes2 = token.groups()
        if tag is None:
            if tag2 is None:
                if page.startswith("<![CDATA[", start):
                    say(page[start + 9 : end - 3])
                else:
                    stack[-1].seen.update(token[0])
                continue
            ending, tag, attributes = ending2, tag2, attributes2
        tag = tag.lower()
        if ending:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in ("p", "br"):
                stack[-1].parts.append(None if tag == "p" else " ")
            continue
        if tag in BLOCK:
            end_open(_P, P_SCOPE)
            if tag in ENDS:
                end_open(*ENDS[tag])
        if tag in VOID:
            stack[-1].seen.update(token[0])
            stack[-1].parts.append(None if tag == "hr" else " " if tag == "br" else "")
            continue
        up = stack[-1]
        set_aside = up.set_aside or bool(up.named)
        out, named = (True, "") if up.out else _leaves_out(tag, attributes, up.marked)
        if set_aside:
            out, named = out or bool(named), ""
        article = tag == "article" and not (out or named or set_aside)
        marked = 0 if out else 2 if article else max(up.marked, tag == "main" and not (named or set_aside))
        stack.append(_Element(tag, out, marked, token[0], named, set_aside))
        open_tags[tag] += 1
        if article or marked > up.marked:
            roots.append(stack[-1])
            mains = mains or tag == "main"
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stack[-1].seen.update(page[at : (at := found.start() if found else len(page))])
        elif attributes.endswith("/") and (open_tags["svg"] or open_tags["math"]):
            close()
    if at < len(page):
        say(page[at:])
    while len(stack) > 1:
        close()
    if not read:
        return hashes, []
    if aside and not tops:
        whole = _size(_blocks(stack[0].parts)) + sum(_size(_blocks(parts)) for _, parts in aside)
        for place, parts in aside:
            if _size(_blocks(parts)) > MOST * whole:
                place.append(parts)
    said = [block for parts in articles for block in _blocks(parts)]
    around = [block for parts in (tops if mains else [stack[0].parts]) for block in _blocks(parts)]
    return hashes, said if _size(said) >= MARKED * _size(around) else around


def host_of(url: str) -> str:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    _, sep, rest = url.partition("://")
    found = re.match(r"[^/?#]*", rest)[0] if sep else ""
    return found.encode().lower().decode()


def section_of(url: str) -> str:
    """The first segment of the path, if more follows it; else empty."""
    found = re.match(r"[^/?#]*/+([^/?#]+)/+[^/?#]", url.partition("://")[2])
    return found[1] if found else ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            hosts, sections, found, within = [], [], [], []
            for url, page in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500).to_pylist(), strict=True):
                own, _ = parse(page or "", read=False)
                hosts += [host_of(url or "")] * (len(own) + 1)
                sections += [xxhash.xxh64_intdigest(section_of(url or "")) - (1 << 63)] * (len(own) + 1)
                found += [None, *own]
                within += [None, *own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (sections, found, within))], names=["host", "section", "subtree", "within"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            pages, templates = part.column(2).to_pylist(), part.column(3).to_pylist()
            texts = ["\n\n".join(parse(p or "", frozenset(t or ()))[1]) for p, t in zip(pages, templates, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template: the hashes of subtrees that recur across the host's pages, or across those of a section. A page counts a subtree once, and min_pages counts pages with copies of one marked element as one."""
    found = pages.select("url", "html").mapInArrow(_subtrees, "host string, section bigint, subtree bigint, within bigint")
    found = materialise(found.groupBy("host", "section", "subtree", "within").agg(F.count("*").alias("n")), "subtrees")

    def recurring(by: list[str]) -> DataFrame:
        places = F.sum(F.when(F.col("within").isNull(), F.col("n")).otherwise(1))
        each = found.groupBy(*by, "subtree", "within").agg(F.sum("n").alias("n")).groupBy(*by, "subtree").agg(F.sum("n").alias("pages"), places.alias("places"))
        each = materialise(each.filter(F.col("subtree").isNull() | (F.col("places") >= min_pages)), "recurring")
        whole = each.filter("subtree IS NULL").select(*by, F.col("pages").alias("all_pages"))
        return each.filter(F.col("subtree").isNotNull()).join(whole, by).filter(F.col("pages") >= F.lit(min_share) * F.col("all_pages")).select("host", "subtree")

    often = recurring(["host"]).union(recurring(["host", "section"]))
    return materialise(often.groupBy("host").agg(F.collect_set("subtree").alias("template")), "templates")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    found = templates(rows, min_pages, min_share).select("host", "template", salts)
    joined = rows.withColumns({"host": host, "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")}).join(found, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
