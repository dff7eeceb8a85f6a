"""Reading documents: spec folders, Markdown, HTML link lists and sections, sidebars, paged responses."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgraph.functions import jsonwalk


def read_files(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """(spec_source, file, content) of the JSON and YAML files in the provider folders below ``folder``, read by Spark.

    The provider is the folder that holds a file. A folder written by Spark for one document (``spec_source=p/file=name.json/part-0``) counts as that file.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    place = F.regexp_extract(F.col("path"), r"([^/]+)/([^/]+\.(?:json|ya?ml))(?:/part-[^/]*)?$", 0)
    name = F.regexp_replace(place, r"/part-[^/]*$", "")
    provider, file = (F.regexp_replace(F.element_at(F.split(name, "/"), k), "^[a-z_]+=", "") for k in (1, -1))
    rows = found.where(name != "").select(provider.alias("spec_source"), file.alias("file"), "content")
    if first is None:
        return rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("spec_source").orderBy("file"))).where(F.col("n") <= first).drop("n")


def read_document(file: str, content: bytes) -> tuple[dict | None, str]:
    """(document, outcome): ``ok``, or no document and ``broken``, ``too deep``, ``not an object``, or ``no reader`` (YAML where no reader of it is installed)."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None, "broken"
    if file.endswith(".json"):
        return jsonwalk.parsed(text)
    try:
        import yaml
    except ModuleNotFoundError:
        return None, "no reader"
    try:
        document = yaml.safe_load(text)
    except yaml.YAMLError:
        return None, "broken"
    except RecursionError:
        return None, "too deep"
    return (document, "ok") if isinstance(document, dict) else (None, "not an object")


def load_corpus(spark: SparkSession, folder: str, first: int | None = None, first_paths: int | None = None) -> DataFrame:
    """(spec_source, source, title, raw) of the documents below ``folder`` (``read_files``).

    Files that hold no document are left out (``corpus_report`` counts them). ``first`` keeps the first files of each provider by name,
    ``first_paths`` the first paths of each document: both are sampling features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for provider, file, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                document = read_document(file, content)[0]
                if document is not None:
                    if first_paths is not None and isinstance(document.get("paths"), dict):
                        document["paths"] = dict(list(document["paths"].items())[:first_paths])
                    info = document.get("info") if isinstance(document.get("info"), dict) else {}
                    out.append((provider, f"{provider}/{file}", str(info.get("title") or ""), jsonwalk.compact(document)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["spec_source", "source", "title", "raw"])

    return read_files(spark, folder, first).mapInArrow(run, "spec_source string, source string, title string, raw string")


def corpus_report(spark: SparkSession, folder: str) -> DataFrame:
    """(spec_source, status, n): files of each provider by outcome (``read_document``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = [read_document(f, c)[1] for f, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string())], names=["spec_source", "status"])

    found = read_files(spark, folder).mapInArrow(run, "spec_source string, status string")
    return found.groupBy("spec_source", "status").agg(F.count("*").alias("n"))


def specs_in_markdown(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spec, example): the first fenced JSON block with ``paths``, and the next JSON block after it; pages without one are left out."""
    blocks = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"```json\s*\n([\s\S]*?)```"), 1)).alias("at", "block"))
    valid = blocks.withColumn("v", F.try_parse_json("block")).where("v IS NOT NULL")
    is_spec = F.schema_of_variant("v").startswith("OBJECT") & F.try_variant_get("v", "$.paths", "variant").isNotNull()
    marked = valid.select(key, "at", F.regexp_replace("block", r"^\s+|\s+$", "").alias("block"), is_spec.alias("is_spec"))
    spec = marked.where("is_spec").groupBy(key).agg(F.min_by("block", "at").alias("spec"), F.min("at").alias("spec_at"))
    after = marked.join(spec.select(key, "spec_at"), key).where("at > spec_at").groupBy(key).agg(F.min_by("block", "at").alias("example"))
    return spec.join(after, key, "left").select(key, "spec", "example")


def link_slugs(pages: DataFrame, key: str, html: str, prefix: str = "/reference/") -> DataFrame:
    """(key, pos, slug): what follows the prefix in each link, each slug once, in page order."""
    found = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rf'href="[^"]*{prefix}([^"#?/]+)"'), 1)).alias("at", "slug"))
    first = found.groupBy(key, "slug").agg(F.min("at").alias("at"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("pos"), "slug")


SIDEBAR = "array<struct<title:string,pages:array<struct<slug:string,title:string,spec:string>>>>"


def sidebar_specs(rows: DataFrame, column: str, allowed: list[str] | None = None) -> DataFrame:
    """(service, spec, slug) of nested sidebar JSON: services by an allow list, ``changelog`` pages left out, one page for each spec title (first by slug)."""
    groups = rows.select(F.explode(F.from_json(column, SIDEBAR)).alias("g")).select(F.col("g.title").alias("service"), F.explode("g.pages").alias("p")).select("service", "p.*")
    if allowed is not None:
        groups = groups.where(F.col("service").isin(allowed))
    kept = groups.where(~F.lower(F.coalesce("slug", F.lit(""))).contains("changelog") & F.col("spec").isNotNull())
    return kept.groupBy("service", "spec").agg(F.min("slug").alias("slug"))


class Sections(HTMLParser):
    """Text of a page split at h1 and h2 below a root element."""

    DROP = frozenset(["script", "style", "details", "noscript"])
    OPENS = frozenset("p br li tr h1 h2 h3 h4 h5 h6 div".split())
    CLOSES = OPENS - {"br", "div"}
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, root: str):
        super().__init__(convert_charrefs=True)
        self.root, self.root_tag, self.inside, self.dropped = root, "", 0, 0  # ``inside`` counts open elements of the root's tag, so that items left open do not count
        self.found: list[list] = []  # heading id, title, text parts
        self.heading: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if not self.inside:
            if tag == self.root or own.get("id") == self.root:
                self.root_tag, self.inside = tag, 1
                if not self.found:
                    self.found.append(["", "", []])
            return
        self.inside += tag == self.root_tag
        if tag in self.DROP:
            self.dropped += 1
        elif not self.dropped:
            if tag in ("h1", "h2"):
                self.heading = tag
                self.found.append([own.get("id") or "", "", []])
            elif tag in self.OPENS:
                self._add("\n")

    def handle_endtag(self, tag: str) -> None:
        self.inside -= bool(self.inside) and tag == self.root_tag
        if not self.inside:
            return
        if tag in self.DROP:
            self.dropped -= bool(self.dropped)
        elif tag == self.heading:
            self.heading = None
        elif not self.dropped and tag in self.CLOSES:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if self.inside and not self.dropped:
            self._add(data)

    def _add(self, text: str) -> None:
        if self.heading:
            self.found[-1][1] += text
        else:
            self.found[-1][2].append(text)


def slug_of(title: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")


def sections(html: str | None, slug: str, root: str) -> list[tuple[str, str, str, str]]:
    """(section id, title, content, fragment) of a page: what stands before the first H1 or H2, then a section for each.

    A section without a title or without content is left out. The text before the first heading is called after it; a page without headings is one section, called after its slug.
    Three and more line ends become two; other white space stays.
    """
    import re

    parser = Sections(root)
    parser.feed(html or "")
    parser.close()
    found = [(anchor, title.strip(), re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()) for anchor, title, parts in parser.found]
    if not found:
        return []
    before = found[0][2]
    if len(found) == 1:
        return [(slug, slug.replace("-", " ").title(), before, "")] if before else []
    out = [(f"{slug}-intro", f"{found[1][1]} — Introduction", before, "")] if before else []
    return out + [(f"{slug}-{anchor or slug_of(title)}", title, content, f"#{anchor}" if anchor else "") for anchor, title, content in found[1:] if title and content]


def page_sections(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, section_id, title, content, source) of every page; a page without the root has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, s, t, c, f"{u or ''}{f}") for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for s, t, c, f in sections(h, str(k), root)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), batch.column(0).type), *(pa.array(list(c), pa.string()) for c in columns[1:])], names=["key", "section_id", "title", "content", "source"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(url), F.col(html)).mapInArrow(run, f"key {kind}, section_id string, title string, content string, source string").withColumnRenamed("key", key)


def _list(v: Column) -> Column:
    """A variant that is a list, else null."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), v)


def response_items(pages: DataFrame, body: str, names: tuple[str, ...] = ("items", "result"), category: str | None = None) -> DataFrame:
    """The page's columns but the body, with ``pos`` and ``item`` (JSON) of every item.

    A list is its own items; an object has those of the first named list in it, then of the list that is called like the page's
    ``category`` column, and is itself the one item if it has a name. Everything else has none.
    """
    v = F.try_parse_json(body)
    lists = [_list(v), *(_list(F.try_variant_get(v, f"$.{n}", "variant")) for n in names)]
    if category is not None:
        # a name from the data is no literal path, so the list is taken by its key from the object's members
        members = F.expr(f"try_cast(try_variant_get(try_parse_json(`{body}`), '$', 'variant') AS map<string,variant>)")
        lists.append(_list(F.try_element_at(members, F.col(category))))
    as_list = F.try_variant_get(F.coalesce(*lists), "$", "array<variant>")
    alone = F.when(F.try_variant_get(v, "$.name", "variant").isNotNull(), F.array(v))
    rest = [c for c in pages.columns if c != body]
    return pages.select(*rest, F.posexplode(F.coalesce(as_list, alone)).alias("pos", "v")).select(*rest, "pos", F.to_json("v").alias("item"))


#: Categories that are asked for where a server does not list its own. Fixed values.
CATEGORIES = ("wlan-ssids", "sw-port-profiles", "gw-port-profiles", "roles", "server-groups", "ntp", "dns", "snmp")


def categories(roots: DataFrame, body: str) -> DataFrame:
    """The root's columns but the body, with ``pos`` and ``category``: names in a list, or in the list ``categories``, ``items`` or ``result``; entries may be objects with a name or category.

    Blank names are left out; a root without such a list has the fixed ones.
    """
    v = F.try_parse_json(body)
    listed = F.coalesce(_list(v), *(_list(F.try_variant_get(v, f"$.{n}", "variant")) for n in ("categories", "items", "result")))

    def named(e: Column) -> Column:
        inside = F.coalesce(F.try_variant_get(e, "$.name", "string"), F.try_variant_get(e, "$.category", "string"))
        return F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(inside)

    own = F.filter(F.transform(F.try_variant_get(listed, "$", "array<variant>"), named), lambda n: n.isNotNull() & (F.trim(n) != ""))
    rest = [c for c in roots.columns if c != body]
    return roots.select(*rest, F.posexplode(F.coalesce(own, F.array(*map(F.lit, CATEGORIES)))).alias("pos", "category"))


def paging_report(pages: DataFrame, source: str, page: str, n_items: str, total: str) -> DataFrame:
    """(source, n_pages, collected, total, truncated): truncated if the last page is not empty and items are missing; an empty page ends a list."""
    return pages.groupBy(source).agg(
        F.count("*").alias("n_pages"), F.sum(n_items).alias("collected"), F.max(total).alias("total"),
        ((F.max_by(n_items, page) > 0) & (F.sum(n_items) < F.max(total))).alias("truncated"),
    )
