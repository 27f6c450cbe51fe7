"""Page, URL, image, decoding, reply-JSON and enum queries (P1-P4, F6, F9/F10, S10, S11,
scan_pages, image_data_url, read_text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.operators import corpus, pages
from codecorpus.plans.registry import query
from codecorpus.session import spread


@query("scan_pages", ["pages"], sql="""
SELECT page_id, url, suffix(url, '.md') OR suffix(url, '.txt') OR suffix(url, '.rst') AS is_plain,
  CASE WHEN suffix(url, '.md') OR suffix(url, '.txt') OR suffix(url, '.rst') THEN html END AS plain_text,
  length(html) AS n_chars FROM pages""")
def q_scan_pages(spark):
    """scan_pages: the pages table as the page source (plain-text URLs pass through)."""
    return pages.scan_pages(spark.table("pages"))


@query("valid_url_scheme", ["v_urls"], sql="""
SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') AS allowed,
  CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN
    '[Disallowed URL scheme ''' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))
    || '''. Only http/https are permitted.]' END AS error
FROM v_urls""")
def q_valid_url(spark):
    """URL scheme check (lower-cased scheme must be http/https)."""
    return pages.valid_url_scheme(spark.table("v_urls"))


def _extracted(spark):
    return pages.extract_pages(spread(spark.table("pages")))


@query("page_markdown", ["pages"])
def q_page_markdown(spark):
    """Markdown of every page (noise removed, main area, blocks)."""
    e = _extracted(spark)
    return e.select("page_id", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("page_facts", ["pages"])
def q_page_facts(spark):
    """Title, description, heading and link lists of every page."""
    e = _extracted(spark)
    return e.select("page_id", "title", "description", F.size("headings").alias("n_headings"),
                    F.size("links").alias("n_links"),
                    F.to_json("headings").alias("headings_json"), F.to_json("links").alias("links_json"))


@query("page_context_clip", ["pages"])
def q_page_clip(spark):
    """The chat message built from each page (URL header + first 8000 chars)."""
    c = pages.page_context_clip(_extracted(spark))
    return c.select("page_id", F.length("message").alias("n_chars"), F.md5("message").alias("message_md5"))


@query("page_toc", ["pages"])
def q_page_toc(spark):
    """Browse view text: title/Untitled, heading outline, numbered links."""
    return pages.page_toc(_extracted(spark))


_IMG_EXT = "CASE doc_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.gif' " \
           "WHEN 4 THEN '.webp' WHEN 5 THEN '.bmp' ELSE '.tiff' END"


@query("image_data_url", ["documents"], sql=f"""
SELECT path, mime, 'data:' || mime || ';base64,' || to_base64(encode(text)) AS data_url FROM (
  SELECT 'img/doc_' || CAST(doc_id AS VARCHAR) || {_IMG_EXT} AS path, text,
    CASE lower(regexp_extract({_IMG_EXT}, '^\\.(.*)$', 1)) {' '.join(f"WHEN '{e}' THEN '{m}'" for e, m in dims.IMAGE_MIME)}
      ELSE '{dims.DEFAULT_IMAGE_MIME}' END AS mime FROM documents) d""")
def q_image_data_url(spark):
    """image_data_url: every document's bytes as an image data URL (MIME by extension)."""
    d = spark.table("documents")
    imgs = d.select(F.concat(F.lit("img/doc_"), F.col("doc_id").cast("string"), F.expr(_IMG_EXT)).alias("path"),
                    F.encode("text", "UTF-8").alias("bytes"))
    return pages.image_data_url(imgs)


@query("read_text", ["documents"], sql="""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(65533) ELSE text END AS text FROM documents""")
def q_read_text(spark):
    """read_text: UTF-8 decode with U+FFFD for malformed bytes (every 4th file ends in a bad byte)."""
    d = spark.table("documents")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xff")))) \
        .otherwise(F.encode("text", "UTF-8"))
    return (d.select("doc_id", raw.alias("raw"))
            .select("doc_id", corpus.decode_text(F.col("raw")).alias("text")))


# a cut sequence, an overlong one, a surrogate, a lone continuation and a byte beyond Unicode, by doc_id % 6
_BAD = ["e282", "c0af", "eda080", "80", "f5", ""]


@query("read_text_ignore", ["documents"], sql="""
SELECT doc_id, 'a' || text || 'z' AS text FROM documents""")
def q_read_text_ignore(spark):
    """read_text, "ignore" mode: malformed bytes in front, within and behind are left out."""
    d = spread(spark.table("documents").select("doc_id", "text"))
    bad = F.unhex(F.get(F.array(*[F.lit(b) for b in _BAD]), (F.col("doc_id") % 6).cast("int")))
    raw = F.concat(bad, F.encode(F.lit("a"), "UTF-8"), bad, F.encode("text", "UTF-8"), bad, F.encode(F.lit("z"), "UTF-8"), bad)
    return d.select("doc_id", raw.alias("raw")).select("doc_id", corpus.decode_text(F.col("raw"), "ignore").alias("text"))


@query("valid_role_format", ["conversations"], sql="""
SELECT conv_id, turn, role, fmt AS format, role IN ('system', 'user', 'assistant') AS role_ok,
  fmt IN ('editblock', 'whole', 'udiff', 'architect') AS format_ok
FROM (SELECT *, CASE (conv_id + turn) % 6 WHEN 0 THEN 'editblock' WHEN 1 THEN 'whole' WHEN 2 THEN 'udiff'
  WHEN 3 THEN 'architect' WHEN 4 THEN 'EditBlock' ELSE 'patch' END AS fmt FROM conversations) c""")
def q_valid_role_format(spark):
    """enum membership of roles and edit formats (invalid rows flagged, not dropped)."""
    c = spark.table("conversations")
    fmt = F.expr("CASE (conv_id + turn) % 6 WHEN 0 THEN 'editblock' WHEN 1 THEN 'whole' WHEN 2 THEN 'udiff' "
                 "WHEN 3 THEN 'architect' WHEN 4 THEN 'EditBlock' ELSE 'patch' END")
    return c.select("conv_id", "turn", "role", fmt.alias("format"),
                    F.col("role").isin(dims.ROLES).alias("role_ok"), fmt.isin(dims.EDIT_FORMATS).alias("format_ok"))


# replies as provider JSON: content, a null content, and an error shape
def _reply_json_spark():
    content = F.when(F.col("turn") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    ok = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content"))
                                              .alias("message"))).alias("choices")))
    err = F.concat(F.lit('{"error":"rate_limited","conv":'), F.col("conv_id").cast("string"), F.lit("}"))
    return F.when(F.col("turn") % 7 == 3, err).otherwise(ok)


@query("reply_text", ["conversations"], sql="""
SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN '{"error":"rate_limited","conv":' || CAST(conv_id AS VARCHAR) || '}'
  WHEN turn % 5 = 0 THEN '' ELSE text END AS reply_text
FROM conversations WHERE role = 'assistant'""")
def q_reply_text(spark):
    """Reply text from provider JSON (NULL content -> '', wrong shape -> the raw reply)."""
    c = spark.table("conversations").filter(F.col("role") == "assistant").withColumn("reply", _reply_json_spark())
    msg = F.get_json_object("reply", "$.choices[0].message")
    txt = F.get_json_object("reply", "$.choices[0].message.content")
    return c.select("conv_id", "turn", F.when(msg.isNull(), F.col("reply"))
                    .otherwise(F.coalesce(txt, F.lit(""))).alias("reply_text"))


@query("chunk_delta", ["v_chunks"], sql="""
SELECT response_id, seq, delta FROM v_chunks WHERE delta IS NOT NULL AND delta <> ''""")
def q_chunk_delta(spark):
    """Stream chunk JSON -> non-empty delta text (others skipped)."""
    c = spark.table("v_chunks")
    js = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta")))
                            .alias("choices")))
    d = F.get_json_object(js, "$.choices[0].delta.content")
    return c.select("response_id", "seq", d.alias("delta")).filter(F.col("delta").isNotNull() & (F.col("delta") != ""))
