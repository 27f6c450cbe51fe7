"""Web page -> Markdown and page facts (P1-P4), URL checks (F6), page source.

Pages are cut into elements and texts with their positions in Arrow batches
(``functions/htmlnodes.py``); which of them are noise, the main area, blocks,
headings and links are expressions over these arrays. Pages are independent,
so the work partitions with the table and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions import htmlnodes
from codecorpus.functions.text import strip_py

# FIXED VALUES -- elements dropped before reading a page, what names a main area, block tags, limits of the facts
NOISE = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "form"]
MAIN_ID = "(?i)content|main|body"
MAIN_CLASS = "(?i)content|main|article|body"
HEADINGS = ["h1", "h2", "h3"]
PARAGRAPHS = ["p", "li", "td", "th"]
LEAST_CHARS = 10
MAX_HEADINGS, LINKS_LOOKED_AT, MAX_LINKS, LINK_CHARS = 15, 30, 20, 60
PLAIN = (".md", ".txt", ".rst")


def is_plain(url: Column) -> Column:
    return url.endswith(PLAIN[0]) | url.endswith(PLAIN[1]) | url.endswith(PLAIN[2])


def _within(at: Column, element: Column) -> Column:
    return (element["opened"] < at) & (at < element["closed"])


def _level(element: Column) -> Column:
    return F.substring(element["tag"], 2, 1).cast("int")


def _text(element: Column, texts: str, field: str = "bare") -> Column:
    """The element's texts (of a column of texts in order), put together."""
    own = F.slice(texts, element["first"] + 1, element["last"] - element["first"])
    return F.array_join(F.transform(F.filter(own, lambda t: ~t["noise"]), lambda t: t[field]), "")


def _block(e: Column) -> Column:
    """The Markdown of one element, NULL where it gives none."""
    text, code = _text(e, "_texts"), strip_py(_text(e, "_texts", "text"))
    return (F.when(e["tag"].isin(HEADINGS) & (text != ""), F.concat(
                F.lit("\n"), F.repeat(F.lit("#"), _level(e)), F.lit(" "), text, F.lit("\n")))
            .when(e["tag"].isin(PARAGRAPHS) & (F.length(text) > LEAST_CHARS), text)
            .when((e["tag"] == "pre") & (code != ""), F.concat(F.lit("\n```\n"), code, F.lit("\n```\n")))
            .when((e["tag"] == "a") & (text != "") & (F.coalesce(e["href"], F.lit("")) != ""),
                  F.concat(F.lit("["), text, F.lit("]("), e["href"], F.lit(")"))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """P1 + P2: (page_id, url, title, description, headings, links, content)."""
    allowed = url_scheme(F.col("url")).isin("http", "https")
    nodes = (pages.select("page_id", "url", F.when(is_plain(F.col("url")), F.col("html")).alias("_plain"),
                          F.when(allowed, F.col("html")).alias("html"))
             .mapInArrow(htmlnodes.parsed, f"page_id long, url string, _plain string, html string, "
                                           f"elements array<{htmlnodes.ELEMENT}>, texts array<{htmlnodes.TEXT}>").drop("html"))
    text = lambda noise: F.transform("texts", lambda t: F.struct(
        t["text"].alias("text"), strip_py(t["text"]).alias("bare"), noise(t["at"]).alias("noise")))
    quiet = lambda at: F.exists("_noise", lambda z: _within(at, z))
    nodes = nodes.withColumn("_noise", F.filter("elements", lambda e: e["tag"].isin(NOISE)))
    nodes = nodes.withColumns({
        "_all": text(lambda at: F.lit(False)), "_texts": text(quiet),
        "_clean": F.filter("elements", lambda e: ~e["tag"].isin(NOISE) & ~quiet(e["opened"]))})
    first = lambda test: F.get(F.filter("_clean", test), F.lit(0))
    area = F.coalesce(first(lambda e: e["tag"] == "main"), first(lambda e: e["tag"] == "article"),
                      first(lambda e: e["id"].rlike(MAIN_ID)), first(lambda e: e["class"].rlike(MAIN_CLASS)),
                      first(lambda e: e["tag"] == "body"))
    nodes = nodes.withColumn("_area", area)
    inner = F.filter("_clean", lambda e: F.col("_area").isNull() | _within(e["opened"], F.col("_area")))
    blocks = F.array_join(F.filter(F.transform(inner, _block), lambda b: b.isNotNull()), "\n")
    markdown = strip_py(F.regexp_replace(blocks, "\n{3,}", "\n\n"))

    tags = lambda test: F.filter("elements", test)
    described = F.get(tags(lambda e: (e["tag"] == "meta") & (e["name"] == "description")), F.lit(0))["content"]
    title = F.get(F.transform(tags(lambda e: e["tag"] == "title"), lambda e: _text(e, "_all")), F.lit(0))
    headings = F.filter(F.transform(tags(lambda e: e["tag"].isin(HEADINGS)), lambda e: F.struct(
        _level(e).alias("level"), _text(e, "_all").alias("text"))), lambda h: h["text"] != "")
    anchors = F.slice(tags(lambda e: (e["tag"] == "a") & e["href"].isNotNull()), 1, LINKS_LOOKED_AT)
    links = F.filter(F.transform(anchors, lambda e: F.struct(F.substring(_text(e, "_all"), 1, LINK_CHARS).alias("text"),
                                                             e["href"].alias("href"))),
                     lambda x: (x["text"] != "") & (x["href"] != "") & ~x["href"].startswith("#"))
    return nodes.select(
        "page_id", "url", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(described, F.lit("")).alias("description"),
        F.slice(headings, 1, MAX_HEADINGS).alias("headings"), F.slice(links, 1, MAX_LINKS).alias("links"),
        F.when(~F.coalesce(allowed, F.lit(False)), scheme_error(F.col("url"))).when(F.col("_plain").isNotNull(), F.col("_plain"))
        .otherwise(markdown).alias("content"))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def scheme_error(url: Column) -> Column:
    return F.concat(F.lit("[Disallowed URL scheme '"), F.coalesce(url_scheme(url), F.lit("")),
                    F.lit("'. Only http/https are permitted.]"))


def valid_url_scheme(urls: DataFrame) -> DataFrame:
    """only http/https pass; others get the bracketed error text."""
    s = url_scheme(F.col("url"))
    ok = s.isin("http", "https")
    return urls.select("page_id", "url", s.alias("scheme"), ok.alias("allowed"),
                       F.when(~ok, scheme_error(F.col("url"))).alias("error"))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Page source: text/markdown URLs pass through as plain text."""
    plain = is_plain(F.col("url"))
    return pages.select("page_id", "url", plain.alias("is_plain"),
                        F.when(plain, F.col("html")).alias("plain_text"), F.length("html").alias("n_chars"))


def page_context_clip(extracted: DataFrame, prefix: str = "Content of ") -> DataFrame:
    """The message added to a chat: URL header + first 8000 characters."""
    return extracted.select("page_id", F.concat(F.lit(prefix), F.col("url"), F.lit(":\n\n"),
                                                F.substring("content", 1, dims.PAGE_CLIP_CHARS)).alias("message"))


def page_toc(extracted: DataFrame) -> DataFrame:
    """Title (or 'Untitled'), indented heading outline and numbered links."""
    toc = F.array_join(F.transform("headings", lambda h: F.concat(
        F.repeat(F.lit("  "), h["level"] - 1), F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"])), "\n")
    links = F.array_join(F.transform("links", lambda x, i: F.concat(
        F.lit("  "), F.lpad((i + 1).cast("string"), 2, " "), F.lit(". "), x["text"], F.lit("  →  "), x["href"])), "\n")
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.lit("Untitled")).otherwise(F.col("title"))
    return extracted.select("page_id", title.alias("title"), toc.alias("toc"), links.alias("links_text"))


def image_data_url(images: DataFrame) -> DataFrame:
    """``image_data_url``: bytes -> ``data:<mime>;base64,...`` (MIME by extension, default png)."""
    from codecorpus.operators.corpus import _lit_map
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^.+\.([^.]+)$", 1))
    mime = F.coalesce(F.element_at(_lit_map(dims.IMAGE_MIME), ext), F.lit(dims.DEFAULT_IMAGE_MIME))
    return images.select("path", mime.alias("mime"),
                         F.concat(F.lit("data:"), mime, F.lit(";base64,"),
                                  # unbroken base64 (Spark may wrap at 76 chars, MIME style)
                                  F.regexp_replace(F.base64("bytes"), "[\r\n]", "")).alias("data_url"))
