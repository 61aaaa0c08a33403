"""Main text of web pages by removal of site templates.

Every block-level element of a page is hashed with all that it contains. Per host, Spark counts on how many pages each such
subtree stands; those on more than ``ratio`` of the host's pages, and on at least ``min_pages``, are the site's template and
are deleted. Pages are counted by their main text, so a page that was copied many times counts once. Inside an
article or main element, headings and paragraphs are content whatever their frequency; only larger subtrees can be a
template there. The named roles of HTML (nav, header, footer, aside, form, ...) and common class names take away what
does not recur literally, such as menus that differ from page to page, adverts and reader comments.

What counts as the page: its article elements; without any, its main elements; without those, its whole body. Character
references are decoded, white space (a line break element included) inside a block becomes one space, blocks are joined by two
line breaks. Broken markup is read as browsers do: open paragraphs and list items end at the next one, whatever is open at
the end is closed there, a tag that is cut off is left out.

Subtree hashes travel, one per page and subtree, and are summed before the shuffle; the templates kept per host are bounded by
the mean number of subtrees on a page divided by ``ratio``. They are joined by host; Spark broadcasts or splits by itself.

Defined cases: null and empty html gives an empty text; pages without a host form one host; repeated rows are all returned; a
page that is alone on its host has no template; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, small_batches, text_of
from postura.operators.ordered import stage

RATIO, MIN_PAGES = 0.5, 3

#: Elements of the standard by role. Fixed values.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table
tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video map datalist".split())
ASIDE = frozenset("nav footer aside form button select textarea fieldset label input dialog menu search".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: What may end an open element of the key when it starts. Fixed values.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Parts of class names and ids of what surrounds an article. Fixed values.
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments
consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo
related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets""".split())
#: First parts of class names that speak of a layout, not of the element itself. Fixed values.
LAYOUT = frozenset("has is layout no page show with without".split())


def _hinted(attrs: list, inside: bool) -> bool:
    for name, value in attrs:
        if name == "role" and (value or "").lower() in ROLES:
            return True
        if name in ("class", "id"):
            for word in (value or "").lower().split():
                parts = re.split("[-_]+", word)
                if parts[0] not in LAYOUT and any(p in HINTS or p == "header" and not inside for p in parts):
                    return True
    return False


class Frame:
    __slots__ = ("tag", "parts", "first", "drop", "hinted", "articles")

    def __init__(self, tag: str, first: int, drop: bool, hinted: bool, articles: int):
        self.tag, self.first, self.drop, self.hinted, self.articles = tag, first, drop, hinted, articles
        self.parts: list[str] = []


class Page(HTMLParser):
    """Blocks of a page with their place, and its subtrees as (hash, first block, end, deletable)."""

    def __init__(self, html: str):
        from xxhash import xxh64_intdigest

        super().__init__(convert_charrefs=True)
        self.hash = xxh64_intdigest
        self.stack = [Frame("", 0, False, False, 0)]
        self.blocks: list[str] = []
        self.place: list[int] = []  # 2 in an article, 1 in main, else 0
        self.dropped: list[bool] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.text: list[str] = []
        self.silent = 0
        self.depth = {"article": 0, "main": 0}
        self.articles = 0
        cut = html.rfind("<")
        if cut > html.rfind(">") and re.match("</?[a-zA-Z]", html[cut:cut + 3]):
            html = html[:cut]
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._end()
        self._flush()

    def _flush(self) -> None:
        words = " ".join("".join(self.text).split()) if self.text else ""
        self.text = []
        if words:
            self.stack[-1].parts.append(words)
            self.blocks.append(words)
            self.place.append(2 if self.depth["article"] else 1 if self.depth["main"] else 0)
            self.dropped.append(False)

    def _end(self) -> None:
        """Close the innermost element."""
        tag = self.stack[-1].tag
        block = tag in BLOCKS
        if block or self.stack[-1].drop:
            self._flush()
        frame = self.stack.pop()
        if tag in SILENT:
            self.silent -= 1
        if tag in self.depth:
            self.depth[tag] -= 1
        end = len(self.blocks)
        if frame.drop and not (frame.hinted and self.articles > frame.articles):
            self.dropped[frame.first:end] = [True] * (end - frame.first)
        if block and frame.first < end:
            value = self.hash(f"{tag}({'|'.join(frame.parts)})") - (1 << 63)
            self.stack[-1].parts.append(str(value))
            inside = self.depth["article"] or self.depth["main"]
            if tag not in ("html", "body", "article", "main") and not (inside and tag in CONTENT):
                self.subtrees.append((value, frame.first, end))
        else:
            self.stack[-1].parts.extend(frame.parts)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            if tag in ENDS:
                self._end_open(ENDS[tag][0].split(), ENDS[tag][1])
            elif tag not in ("html", "body"):
                self._end_open(["p"], ("table", "td", "button"))
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        inside = bool(self.depth["article"] or self.depth["main"])
        hinted = tag not in ("html", "body", "main") and _hinted(attrs, inside)
        if tag == "article":  # a reader's comment may be an article, a sidebar's neighbour is not one
            hinted = hinted and any("comment" in (v or "") for k, v in attrs if k in ("class", "id"))
        drop = tag in ASIDE or hinted or tag == "header" and not inside
        if drop:
            self._flush()
        self.stack.append(Frame(tag, len(self.blocks), drop, hinted and tag not in ASIDE, self.articles))
        if tag in SILENT:
            self.silent += 1
        if tag in self.depth:
            self.depth[tag] += 1
            self.articles += not hinted

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the closing slash means nothing on elements that have an end

    def _end_open(self, tags: list[str], scope: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self._end()
                return
            if tag in scope or tags == ["p"] and tag in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._end()
                return
            if tag not in BLOCKS and tag not in SILENT and self.stack[i].tag in BLOCKS:
                return  # an inline end does not close a block

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)

    def kept(self, template: set[int] | frozenset[int] = frozenset()) -> list[str]:
        """Blocks of the main text, without the subtrees of a template."""
        gone = [*self.dropped]
        for value, first, end in self.subtrees:
            if value in template:
                gone[first:end] = [True] * (end - first)
        level = max((p for p, d in zip(self.place, self.dropped) if not d), default=0)
        return [b for b, p, d in zip(self.blocks, self.place, gone) if p >= level and not d]


JOIN = "\n\n"


def _host(url: Column) -> Column:
    """Join key: the host of an address in lower case, without user and port; null and other texts are one host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def _outlines(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh64_intdigest

    for texts in batches:
        found = [Page(t) for t in texts]
        yield pd.DataFrame({"content": [xxh64_intdigest(JOIN.join(p.kept())) - (1 << 63) for p in found],
                            "subtrees": [sorted({s[0] for s in p.subtrees}) for p in found]})


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, templates in batches:
        rows = []
        for t, template in zip(texts, templates):
            page = Page(t)
            chosen = frozenset() if template is None else frozenset(map(int, template))
            rows.append((JOIN.join(page.kept(chosen)), sum(s[0] in chosen for s in page.subtrees)))
        yield pd.DataFrame(rows, columns=["text", "n_template"])


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO,
              min_pages: int = MIN_PAGES) -> DataFrame:
    """Staged: ``host`` and ``subtrees``, the hashes of its template."""
    small_batches(df.sparkSession)
    outline = F.pandas_udf(_outlines, "content long, subtrees array<long>")
    pages = (df.select(_host(column(url_col)).alias("host"), outline(text_of(html_col)).alias("o"))
             .groupBy("host", F.col("o.content").alias("content")).agg(F.first("o.subtrees").alias("subtrees")))
    pages = stage(pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (pages.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    often = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return stage(often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO,
            min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), n_template (subtrees deleted as template)."""
    known = templates(df, url_col, html_col, ratio, min_pages).select(F.col("host").alias("_h"), "subtrees")
    rows = df.select(column(id_col).alias("page_id"), column(url_col).alias("url"), text_of(html_col).alias("html"))
    joined = rows.join(known, _host(F.col("url")) == F.col("_h"), "left")
    main = F.pandas_udf(_texts, "text string, n_template long")
    out = joined.select("page_id", "url", main("html", "subtrees").alias("m"))
    return out.select("page_id", "url", F.col("m.text").alias("text"), F.length("m.text").cast("long").alias("n_chars"),
                      F.col("m.n_template").alias("n_template"))


by_value(__name__)
