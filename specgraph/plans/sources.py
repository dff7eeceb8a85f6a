"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators import specs
from specgraph.plans.bridge import dealt, frame
from specgraph.plans.registry import query
from specgraph.sources import documents, sinks

MARKDOWN = """SELECT doc_id, 'intro ' || CAST(doc_id AS STRING) || chr(10) || '```json' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '{"paths":{"/a' || CAST(doc_id AS STRING) || '":{}}}' WHEN 1 THEN '{"other":1}' ELSE '{broken' END || chr(10) || '```' || chr(10) || 'text' || chr(10)
 || '```json' || chr(10) || '{"n":' || CAST(n_chars AS STRING) || '}' || chr(10) || '```' || chr(10) AS md FROM documents"""


@query("SELECT doc_id, '{\"paths\":{\"/a' || CAST(doc_id AS STRING) || '\":{}}}' AS spec, '{\"n\":' || CAST(n_chars AS STRING) || '}' AS example FROM documents WHERE doc_id % 3 = 0")
def io_2_markdown_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-2: each document as Markdown with fenced blocks."""
    return documents.specs_in_markdown(frame(spark, sf_dir, MARKDOWN), "doc_id", "md")


@query(
    r"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ix)::INT AS pos, slug FROM (SELECT page_id, slug, min(ix) AS ix FROM (SELECT page_id, unnest(s) AS slug, generate_subscripts(s, 1) AS ix
    FROM (SELECT page_id, regexp_extract_all(html, 'href="[^"]*/([^"#?/]+)"', 1) AS s FROM pages) a) b GROUP BY page_id, slug) c"""
)
def io_3_link_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-3: link slugs in page order."""
    return documents.link_slugs(frame(spark, sf_dir, "SELECT page_id, html FROM pages"), "page_id", "html", "/")


SIDE = """SELECT 'S' || CAST(p_size % 10 AS STRING) AS service, CASE WHEN p_partkey % 9 = 0 THEN 'changelog-' ELSE 'page-' END || CAST(p_partkey AS STRING) AS slug, 'Spec ' || CAST(p_partkey % 50 AS STRING) AS spec FROM part"""


@query(f"SELECT service, spec, min(slug) AS slug FROM ({SIDE}) s WHERE service <> 'S9' AND slug NOT LIKE '%changelog%' GROUP BY service, spec")
def io_4_sidebar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-4: nested sidebar JSON, one row per service."""
    pages = frame(spark, sf_dir, SIDE).groupBy("service").agg(F.collect_list(F.struct("slug", F.lit("t").alias("title"), "spec")).alias("pages"))
    side = pages.select(F.to_json(F.array(F.struct(F.col("service").alias("title"), "pages"))).alias("json"))
    return documents.sidebar_specs(side, "json", [f"S{i}" for i in range(9)])


@query()
def io_5_page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-5: sections of every page; tests/ hold expected ones."""
    return documents.page_sections(frame(spark, sf_dir, "SELECT page_id, url, html FROM pages"), "article")


_HTML = """'<html><head><title>x</title></head><body><h1>outside</h1><div id="main-content">' || CASE WHEN k % 3 = 0 THEN '' ELSE 'before ' || t || '<p>second</p>' END || '<h1 id="top-' || t || '">Title <a href="#x">' || t || '</a></h1><p>one &amp; two</p><ul><li>a<li>b</ul><script>gone()</script>'
    || '<details><h2>hidden</h2>gone</details><div><img src=x>three<br>four</div><p></p><p></p><h3>deep</h3>tail<h2>Second Part: ' || t || '!</h2><noscript>gone</noscript>text' || CASE WHEN k % 2 = 0 THEN '<h2 id="empty">Empty</h2><p> </p>' ELSE '' END || '<h2> </h2>lost</div><h2>after</h2>out</body></html>'"""
_PLAIN = "'<body><div id=\"main-content\"><p>all of ' || t || '</p><h3>low</h3>end</div></body>'"


@query(
    """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS t, p_partkey AS k, 'page-' || CAST(p_partkey AS VARCHAR) AS slug FROM part) SELECT slug, slug || '-intro' AS section_id, 'Title ' || t || ' — Introduction' AS title, 'before ' || t || chr(10) || 'second' AS content, 'u/' || t AS source FROM x WHERE k % 5 <> 0 AND k % 3 <> 0
    UNION ALL SELECT slug, slug || '-top-' || t, 'Title ' || t, 'one & two' || repeat(chr(10), 2) || 'a' || chr(10) || 'b' || chr(10) || 'three' || chr(10) || 'four' || repeat(chr(10), 2) || 'deep' || chr(10) || 'tail', 'u/' || t || '#top-' || t FROM x WHERE k % 5 <> 0
    UNION ALL SELECT slug, slug || '-second-part-' || t, 'Second Part: ' || t || '!', 'text', 'u/' || t FROM x WHERE k % 5 <> 0 UNION ALL SELECT slug, slug, 'Page ' || t, 'all of ' || t || repeat(chr(10), 2) || 'low' || chr(10) || 'end', 'u/' || t FROM x WHERE k % 5 = 0"""
)
def io_5_written_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-5: sections of written pages: an introduction, headings with and without ids, dropped parts, empty and nameless sections, pages without headings."""
    pages = frame(spark, sf_dir, f"SELECT 'page-' || t AS slug, 'u/' || t AS url, CASE WHEN k % 5 = 0 THEN {_PLAIN} ELSE {_HTML} END AS html FROM ({dealt(spark, 'SELECT CAST(p_partkey AS STRING) AS t, p_partkey AS k FROM part')}) x")
    return documents.page_sections(pages, "main-content", key="slug")


RESPONSES = "SELECT o_orderkey AS page, o_custkey AS source, 7 AS total FROM orders"


@query("SELECT l_orderkey AS page, l_partkey AS part, count(*) AS n FROM lineitem GROUP BY ALL")
def io_6_response_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-6, IO-7: items of landed responses: a list, or a list under a name."""
    pages = frame(spark, sf_dir, "SELECT l_orderkey AS page, l_partkey AS part FROM lineitem").groupBy("page").agg(F.collect_list(F.struct("part")).alias("items"))
    body = F.when(F.col("page") % 3 == 0, F.to_json("items")).when(F.col("page") % 3 == 1, F.to_json(F.struct("items"))).otherwise(F.to_json(F.struct(F.col("items").alias("result"))))
    found = documents.response_items(pages.select("page", body.alias("body")), "body")
    return found.select("page", F.get_json_object("item", "$.part").cast("long").alias("part")).groupBy("page", "part").agg(F.count("*").alias("n"))


PAGED = "SELECT l_partkey AS source, l_orderkey AS page, CASE WHEN max(l_quantity) > 48 THEN 0 ELSE count(*) END AS n_items, l_partkey % 50 AS total FROM lineitem GROUP BY l_partkey, l_orderkey"


@query(f"SELECT source, count(*) AS n_pages, sum(n_items)::BIGINT AS collected, max(total) AS total, arg_max(n_items, page) > 0 AND sum(n_items) < max(total) AS truncated FROM ({PAGED}) p GROUP BY source")
def io_6_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-6: which lists were cut short."""
    return documents.paging_report(frame(spark, sf_dir, PAGED), "source", "page", "n_items", "total")


@query("SELECT 'v1' AS version, '{\"component\":' || (SELECT count(*) FROM b_component) || ',\"endpoint\":' || (SELECT count(*) FROM b_endpoint) || '}' AS tables")
def io_10_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-10: counts of the tables. The manifest's gates are left to ``ag_18_gates``; nothing is written here."""
    tables = {n: frame(spark, sf_dir, f"b_{n}") for n in ("component", "endpoint")}
    return sinks.table_sizes(tables).select(F.lit("v1").alias("version"), "tables")


NEW = "SELECT s_name AS name, 'new' AS text FROM supplier WHERE s_suppkey % 3 <> 0"
OLD = "SELECT s_name AS name, 'old' AS text, s_acctbal AS last_run, s_suppkey % 2 AS last_exit_code FROM supplier WHERE s_suppkey % 4 <> 0"


@query(f"SELECT coalesce(n.name, o.name) AS name, coalesce(n.text, o.text) AS text, o.last_run, o.last_exit_code FROM ({NEW}) n FULL JOIN ({OLD}) o ON o.name = n.name")
def io_11_keep_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-11."""
    return sinks.keep_run_state(frame(spark, sf_dir, NEW), frame(spark, sf_dir, OLD))


BLOBS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'b64:' || base64(encode(text, 'utf-8')) WHEN 1 THEN 'b64:%%%' ELSE text END AS stored FROM documents"


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'b64:%%%' ELSE coalesce(text, '') END AS json FROM documents")
def sg_12_decode_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG-12: stored blobs of whole texts, bad ones kept as they are."""
    return frame(spark, sf_dir, BLOBS).select("doc_id", specs.decode_blob(F.col("stored")).alias("json"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'b64:%%%' ELSE coalesce(text, '') END AS json FROM documents")
def sg_12_decode_whole_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG-12: every document's whole text, as ``sg_12_decode_blobs``, which once had beginnings only."""
    return sg_12_decode_blobs(spark, sf_dir)
