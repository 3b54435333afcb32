"""HTML pages: title, visible text and links."""

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import ship

_HIDDEN = {"script", "style", "noscript", "template", "head"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.hidden, self.in_title, self.seen_title = [], [], [], 0, False, False

    def handle_starttag(self, tag, attrs):
        if tag == "title" and not self.seen_title:
            self.in_title = self.seen_title = True
        elif tag in _HIDDEN:
            self.hidden += 1
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append(href)
        if tag not in _INLINE:
            self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag not in _INLINE:
            self.text.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)


def parse_page(html: str | None, url: str | None) -> tuple[str, str, list[str]]:
    """Title, visible text with runs of white space as one space, and absolute links; malformed links are left out."""
    if not html or not html.strip():
        return "", "", []
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        pass  # the rest of a page that can't be read any further
    links = []
    for link in page.links:
        try:
            absolute = urljoin(url or "", link.strip())
            if urlsplit(absolute).scheme:
                links.append(absolute)
        except ValueError:
            continue
    return " ".join("".join(page.title).split()), " ".join("".join(page.text).split()), links


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, links of ``pages`` (page_id, url, html): one Arrow pass with the standard library's parser."""
    ship(pages.sparkSession)

    @F.pandas_udf("title string, text string, links array<string>")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, u) for h, u in zip(html, url, strict=True)], columns=["title", "text", "links"])

    return pages.select("page_id", "url", run("html", "url").alias("p")).select("page_id", "url", "p.title", "p.text", "p.links")


def hrefs(html: Column) -> Column:
    """The href values of anchors, as written, in the JVM: for plain pages where a full parse isn't needed."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def page_links(pages: DataFrame) -> DataFrame:
    """src, url: canonical absolute links of ``pages`` (page_id, url, html), by ``hrefs``."""
    found = pages.select(F.col("page_id").alias("src"), F.col("url").alias("base"), F.explode(hrefs(F.col("html"))).alias("link"))
    return found.select("src", T.normalize_url(T.resolve_url(F.col("base"), F.col("link"))).alias("url")).where("url IS NOT NULL")
