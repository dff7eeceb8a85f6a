"""Documents to tables: cleaning, flattening, reference links, endpoint, parameter, body, component and property rows, overlay nodes.

A corpus row is (spec_source, source, title, raw). ``flatten`` writes one row per JSON value; everything after it is joins and
filters on those rows, keyed by (spec_id, pointer).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgraph.functions import jsonwalk, views
from specgraph.functions.expand import Expansion

AST = "spec_id string, pointer string, parent string, key string, idx int, kind string, value_type string, name string, scalar string, raw string, is_extension boolean, ord int, depth int"
_AST_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
#: Rows of a written batch.
ROWS = 20_000


def spec_id(source: str, document: dict, digest: str | None = None) -> str:
    """The document's id from its source and content (or the content's hash, if that is known)."""
    return "oas:" + hashlib.sha1(f"{source}\0{digest or jsonwalk.content_hash(document)}".encode()).hexdigest()[:20]


def parsed(raw: str | None) -> dict | None:
    """The document, or None for what is not a JSON object or is nested too deeply."""
    return jsonwalk.parsed(raw)[0]


def map_documents(corpus: DataFrame, change: Callable[[dict], dict]) -> DataFrame:
    """The corpus with each document changed and written as compact JSON. Rows that are not JSON objects are left out (count them with ``outcomes``)."""
    place = corpus.columns.index("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [jsonwalk.compact(change(d)) if (d := parsed(r)) is not None else None for r in batch.column(place).to_pylist()]
            columns = [pa.array(made, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([m is not None for m in made], pa.bool_()))

    return corpus.mapInArrow(run, corpus.schema)


def clean(corpus: DataFrame) -> DataFrame:
    return map_documents(corpus, jsonwalk.cleaned)


def normalised(corpus: DataFrame) -> DataFrame:
    """Cleaned, then repeated error responses and objects made into components; doing it twice changes nothing more."""
    return map_documents(corpus, lambda d: jsonwalk.shared(jsonwalk.cleaned(d), copy=False))


def settled(corpus: DataFrame) -> DataFrame:
    """(spec_source, source, same): whether normalising a document again changes nothing, by content hashes. The second time begins with the text that the first one writes."""

    def rows(document: dict) -> Iterator[tuple]:
        once = parsed(jsonwalk.compact(jsonwalk.shared(jsonwalk.cleaned(document), copy=False)))
        if once is not None:
            first = jsonwalk.content_hash(once)
            yield (first == jsonwalk.content_hash(jsonwalk.shared(jsonwalk.cleaned(once), copy=False)),)

    return document_rows(corpus, "same boolean", rows)


#: Longest expanded text that is written; a longer one (references that branch again and again) is null, and its length is given.
MOST_TEXT = 1 << 26


def expand_references(corpus: DataFrame, most: int = MOST_TEXT) -> DataFrame:
    """The corpus with all references of each document expanded; raw is null where that is longer than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = [parsed(r) for r in batch.column("raw").to_pylist()]
            made = [None if d is None else Expansion(d).text(d, most)[0] for d in documents]
            columns = [pa.array(made, pa.string()) if name == "raw" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([d is not None for d in documents], pa.bool_()))

    return corpus.mapInArrow(run, corpus.schema)


def expanded_components(corpus: DataFrame, most: int = MOST_TEXT) -> DataFrame:
    """(source, section, name, body, n_chars): every component with all its references expanded, circles and what lies deeper marked; body is null where it is longer than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document = parsed(raw) or {}
                expansion, rows = Expansion(document), []
                for section, parts in views.as_object(document.get("components")).items():
                    rows += [(source, section, name, *expansion.text(body, most)) for name, body in views.as_object(parts).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["source", "section", "name", "body", "n_chars"])

    return corpus.select("source", "raw").mapInArrow(run, "source string, section string, name string, body string, n_chars long")


def _surely_ok(raw: Column) -> Column:
    """True for texts that Spark's own reader takes for one JSON object, with nothing after it: its strict form takes less than ``jsonwalk.parsed`` (no deep nesting, no very long numbers).

    The reader says nothing of what follows a value, so the text is read as the first item of a list whose last one holds the text's hash.
    """
    mark = F.xxhash64(raw)
    listed = F.concat(F.lit("["), raw, F.lit(',{"h":'), mark.cast("string"), F.lit("}]"))
    read = F.from_json(listed, "array<struct<h:bigint>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.startswith(raw, F.lit("{")) & read.eqNullSafe(F.array(F.struct(F.lit(None).cast("bigint").alias("h")), F.struct(mark.alias("h"))))


def outcomes(corpus: DataFrame) -> DataFrame:
    """(spec_source, status, n): rows that are documents (``ok``), and others by why they are none: ``broken``, ``too deep``, ``not an object``.

    Every text is read where it is made; those that are not surely documents are read again by the library's own reader, which decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = ["ok" if ok else jsonwalk.parsed(r)[1] for r, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string())], names=["spec_source", "status"])

    read = corpus.select("spec_source", "raw", F.coalesce(_surely_ok(F.col("raw")), F.lit(False)).alias("ok")).select("spec_source", F.when(~F.col("ok"), F.col("raw")).alias("raw"), "ok")
    return read.mapInArrow(run, "spec_source string, status string").groupBy("spec_source", "status").agg(F.count("*").alias("n"))


def flatten(corpus: DataFrame, columns: Sequence[str] | None = None, kinds: Collection[str] | None = None, closed: Collection[str] = (), deepest: int = jsonwalk.DEEPEST, keys: Callable[[str | None], bool] | None = None) -> DataFrame:
    """One row per JSON value of every document, in document order (``ord``). Rows that are not JSON objects are left out.

    ``columns`` are those of ``AST`` (all, if not given), ``source`` or ``spec_source``, ``kinds`` the kinds of values wanted: a Python step cannot be pruned
    by Spark, and the text of nested values and the document's hash are the costly part of it, so they are made only where they are asked for.
    ``closed`` and ``deepest`` say below what no value is wanted (see ``jsonwalk.walk``), ``keys`` which keys are, besides the document itself.
    """
    names = [c.split()[0] for c in AST.split(", ")]
    types = dict(zip(names, _AST_TYPES, strict=True)) | {"source": pa.string(), "spec_source": pa.string()}
    given = ("source", "spec_source", *names)
    wanted = list(columns or names)
    places = [given.index(c) for c in wanted]
    ids, texts = "spec_id" in wanted, "raw" in wanted
    kept, shut = None if kinds is None else frozenset(kinds), frozenset(closed)
    inputs = ["source", "raw", *(["spec_source"] if "spec_source" in wanted else [])]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        made = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(made[k], types[c]) for k, c in zip(places, wanted, strict=True)], names=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            providers = batch.column(2).to_pylist() if len(inputs) > 2 else [None] * batch.num_rows
            for source, raw, provider in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), providers, strict=True):
                document = parsed(raw)
                if document is None:
                    continue
                own = spec_id(source, document) if ids else None
                found = jsonwalk.walk(document, texts, kept, wanted, shut, deepest)
                rows += [(source, provider, own, *row) for row in (found if keys is None else (r for r in found if not r[11] or keys(r[2])))]
                if len(rows) >= ROWS:
                    for lo in range(0, len(rows), ROWS):
                        yield packed(rows[lo : lo + ROWS])
                    rows = []
        for lo in range(0, len(rows), ROWS):
            yield packed(rows[lo : lo + ROWS])

    schema = dict(c.split() for c in AST.split(", ")) | {"source": "string", "spec_source": "string"}
    return corpus.select(inputs).mapInArrow(run, ", ".join(f"{c} {schema[c]}" for c in wanted))


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def document_rows(corpus: DataFrame, schema: str, rows_of: Callable[..., Iterable[tuple]], given: Sequence[str] = ("spec_source", "source"), named: bool = False) -> DataFrame:
    """(given columns, then those of ``schema``): the rows that ``rows_of`` makes of each document, and of its given columns if it is ``named``. Rows of the corpus that are not JSON objects are left out."""
    made = [c.split() for c in schema.split(", ")]
    n, types = len(given), [pa.string()] * len(given) + [_ARROW[t] for _, t in made]
    names = [*given, *(c for c, _ in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for own in zip(*(batch.column(k).to_pylist() for k in range(n + 1)), strict=True):
                document = parsed(own[n])
                if document is not None:
                    rows += [own[:n] + r for r in (rows_of(document, *own[:n]) if named else rows_of(document))]
                if len(rows) >= ROWS:
                    for lo in range(0, len(rows), ROWS):
                        yield packed(rows[lo : lo + ROWS])
                    rows = []
        for lo in range(0, len(rows), ROWS):
            yield packed(rows[lo : lo + ROWS])

    return corpus.select(*given, "raw").mapInArrow(run, ", ".join([*(f"{c} string" for c in given), schema]))


def reference_rows(corpus: DataFrame, below: str = "") -> DataFrame:
    """(spec_source, source, pointer, ref, found): internal references, as ``references`` finds them among flattened rows, and whether they name something.

    A reference and what it names are in one document, so it is read once and no pointer is a row. ``below``: only those below this pointer.
    """

    def rows(document: dict) -> Iterator[tuple]:
        there: dict[str, bool] = {}
        for pointer, ref in jsonwalk.reference_values(jsonwalk.by_pointer(document, below), at=below):
            if isinstance(ref, str) and ref.startswith("#"):
                if ref not in there:
                    there[ref] = jsonwalk.stands(document, ref[1:])
                yield pointer, ref, there[ref]

    return document_rows(corpus, "pointer string, ref string, found boolean", rows)


def reference_links(corpus: DataFrame) -> DataFrame:
    """(spec_source, source, ref, found, n): how often each document refers to something, and whether that is there."""

    def rows(document: dict) -> list[tuple]:
        named = Counter(ref for _, ref in jsonwalk.reference_values(document, False) if isinstance(ref, str) and ref.startswith("#"))
        return [(ref, jsonwalk.stands(document, ref[1:]), n) for ref, n in named.items()]

    return document_rows(corpus, "ref string, found boolean, n long", rows)


def counted_references(document: dict) -> tuple[int, int, int]:
    """(internal references that name something, that name nothing, references to other files) of a document."""
    named = Counter(ref if isinstance(ref, str) else "" for _, ref in jsonwalk.reference_values(document, False))
    inner = {ref: n for ref, n in named.items() if ref.startswith("#")}
    found = sum(n for ref, n in inner.items() if jsonwalk.stands(document, ref[1:]))
    return found, sum(inner.values()) - found, sum(named.values()) - sum(inner.values())


def reference_counts(corpus: DataFrame) -> DataFrame:
    """(spec_source, source, n_found, n_lost, n_external) of every document: ``counted_references``."""
    return document_rows(corpus, "n_found long, n_lost long, n_external long", lambda d: [counted_references(d)])


def spec_rows(corpus: DataFrame, columns: Sequence[str] = ("spec_id", "spec_source", "source", "title", "version", "content_hash")) -> DataFrame:
    """(spec_id, spec_source, source, title, version, content_hash) of every document, or those of these that are wanted and ``raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (spec_id(s, d, h := jsonwalk.content_hash(d)), p, s, t, str(views.as_object(d.get("info")).get("version") or ""), h, r)
                for p, s, t, r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
                if (d := parsed(r)) is not None
            ]
            made = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(made[given.index(c)]), pa.string()) for c in columns], names=list(columns))

    given = ("spec_id", "spec_source", "source", "title", "version", "content_hash", "raw")
    return corpus.select("spec_source", "source", "title", "raw").mapInArrow(run, ", ".join(f"{c} string" for c in columns))


def shared_shapes(corpus: DataFrame, least: int = 2, properties: int = 3) -> DataFrame:
    """(hash, names, n, n_specs): what ``projection.shared_objects`` gives, from the documents themselves.

    A value's hash is made of its members' hashes, and all members are in one document, so no value needs a row: a document has one for each different object.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document = parsed(raw)
                if document is not None:
                    own = spec_id(source, document)
                    rows += [(own, digest, n, names) for digest, (n, names) in jsonwalk.inline_objects(document, properties).items()]
            made = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["spec_id", "hash", "n", "names"])

    found = corpus.select("source", "raw").mapInArrow(run, "spec_id string, hash string, n long, names string")
    by_spec = found.groupBy("hash", "spec_id").agg(F.sum("n").alias("n"), F.min("names").alias("names"))
    return by_spec.groupBy("hash").agg(F.min("names").alias("names"), F.sum("n").alias("n"), F.count("*").alias("n_specs")).where(F.col("n") >= least)


def rebuilt(ast: DataFrame) -> DataFrame:
    """(spec_id, raw): each document put together again from its rows. A group is one document, as large as a document."""

    def build(key, rows):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = rows.sort_values("ord")
        made = jsonwalk.rebuild(list(zip(rows["pointer"], rows["parent"].where(rows["parent"].notna(), None), rows["key"], rows["value_type"], rows["scalar"], strict=True)))
        return pd.DataFrame([[key[0], jsonwalk.compact(made)]], columns=["spec_id", "raw"])

    return ast.select("spec_id", "pointer", "parent", "key", "value_type", "scalar", "ord").groupBy("spec_id").applyInPandas(build, "spec_id string, raw string")


def rebuilt_in_order(rows: DataFrame) -> DataFrame:
    """(source, raw): ``rebuilt`` from rows (source, key, value_type, scalar, depth) that lie as ``flatten`` makes them: a document's together and in order, whatever batches they are in. Nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: list[str] = []

        def values() -> Iterator[tuple]:
            for batch in batches:
                depths = batch.column(4)
                sources.extend(batch.column(0).filter(pc.equal(depths, 0)).to_pylist())
                yield from zip(depths.to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)

        made: list[str] = []
        for document in jsonwalk.rebuild_in_order(values()):
            made.append(jsonwalk.compact(document))
            if len(made) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(sources[:1000], pa.string()), pa.array(made, pa.string())], names=["source", "raw"])
                del sources[:1000]
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(made, pa.string())], names=["source", "raw"])

    return rows.select("source", "key", "value_type", "scalar", "depth").mapInArrow(run, "source string, raw string")


def text_of(scalar: Column) -> Column:
    """The text of a JSON string value."""
    return F.get_json_object(F.concat(F.lit('{"v":'), scalar, F.lit("}")), "$.v")


def references(ast: DataFrame) -> DataFrame:
    """(spec_id, pointer, ref, target): internal references and the pointer they name, null if nothing is there."""
    refs = ast.where("key = '$ref' AND value_type = 'scalar'").select("spec_id", F.col("parent").alias("pointer"), text_of(F.col("scalar")).alias("ref")).where("ref LIKE '#%'")
    refs = refs.withColumn("wanted", F.expr("substring(ref, 2)"))
    targets = ast.select("spec_id", F.col("pointer").alias("wanted"), F.lit(True).alias("there"))
    return refs.join(targets.hint("merge"), ["spec_id", "wanted"], "left").select("spec_id", "pointer", "ref", F.when(F.col("there"), F.col("wanted")).alias("target"))


def last_site(pointer: Column) -> Column:
    """The last structural keyword of a pointer below its component: where a reference stands."""
    return F.regexp_extract(pointer, r".*/(properties|items|allOf|oneOf|anyOf|additionalProperties)(?:/|$)", 1)


def component_of(pointer: Column) -> Column:
    return F.regexp_extract(pointer, r"^/components/schemas/([^/]*)", 1)


def member(key: str) -> Column:
    return F.max(F.when(F.col("key") == key, F.col("scalar")))


def members(ast: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """(spec_id, pointer, raw, ...keys): nodes of a kind with the texts of their scalar members."""
    nodes = ast.where(F.col("kind") == kind).where("value_type = 'object'").select("spec_id", "pointer", "raw", F.col("key").alias("own_key"), F.col("parent").alias("up"), F.col("ord").alias("own_ord"))
    below = ast.where(F.col("key").isin(keys) & (F.col("value_type") == "scalar")).groupBy("spec_id", F.col("parent").alias("pointer")).agg(*[text_of(member(k)).alias(k) for k in keys])
    return nodes.join(below, ["spec_id", "pointer"], "left")


#: Scalar members of an operation that are columns of its endpoint.
ENDPOINT_KEYS = ["operationId", "summary", "deprecated"]


def endpoint_values(corpus: DataFrame) -> DataFrame:
    """The rows and columns of the flattened corpus that ``endpoint_rows`` reads; no text of a nested value is made for them."""
    rows = flatten(corpus, ("spec_id", "pointer", "parent", "key", "kind", "value_type", "scalar", "ord"), ("Operation", "Scalar"))
    return rows.where((F.col("kind") == "Operation") | F.col("key").isin(ENDPOINT_KEYS)).withColumn("raw", F.lit(None).cast("string"))


def endpoint_rows(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(eid, method, path, category, operation_id, summary, deprecated, spec_id, pointer): one per method and path; of equal ones the first by source and order stays."""
    return first_operations(members(ast, "Operation", ENDPOINT_KEYS).where("pointer LIKE '/paths/%'").join(specs.select("spec_id", "source", "title"), "spec_id"), "spec_id")


#: Kinds below which no operation of a path stands.
NO_OPERATIONS = frozenset(
    "Info Components Parameter RequestBody Response MediaType Header Example Tag ExternalDocs Discriminator Encoding SecurityScheme OAuthFlows OAuthFlow Link Server ServerVariable Schema Property Items Extension Constraint".split()
)
#: A part of an operation: of its path item (1) or its own (0), its position, its place below the operation, its text, the pointer it refers to and the text found there in the document.
PART = "struct<prio:int,idx:int,slot:string,raw:string,wanted:string,own_body:string>"
_ARROW[f"array<{PART}>"] = pa.list_(pa.struct([(f.split(":")[0], _ARROW[f.split(":")[1]]) for f in PART[7:-1].split(",")]))


def _part(document: dict, prio: int, idx: int, slot: str, value: dict, raw: str | None = None) -> dict:
    ref = value.get("$ref")
    wanted = ref[1:] if raw is None and isinstance(ref, str) and ref.startswith("#/") else None
    own = None
    if wanted is not None and jsonwalk.stands(document, wanted) and isinstance(named := jsonwalk.by_pointer(document, wanted), dict):
        _, _, section, *rest = [*wanted.split("/"), "", ""]
        detailed = wanted.startswith("/components/") and section in ("parameters", "requestBodies", "responses") and wanted.count("/") == 3
        # what stands elsewhere has the text that a row of it has
        own = jsonwalk.compact(named) if detailed else next(r[8] for r in jsonwalk.walk(document) if r[0] == wanted)
    return {"prio": prio, "idx": idx, "slot": slot, "raw": jsonwalk.compact(value) if raw is None else raw, "wanted": wanted, "own_body": own}


def _parameters(document: dict, operation: dict, item: Any) -> list[dict]:
    lists = ((0, operation.get("parameters")), (1, views.as_object(item).get("parameters")))
    return [_part(document, prio, i, "parameters", p) for prio, given in lists if isinstance(given, list) for i, p in enumerate(given) if isinstance(p, dict)]


def _bodies(document: dict, operation: dict, item: Any) -> list[dict]:
    body, responses = operation.get("requestBody"), operation.get("responses")
    found = [_part(document, 0, 0, "requestBody", body)] if isinstance(body, dict) else []
    if isinstance(responses, list):  # a list where a map belongs: its rows have no text
        return found + [_part(document, 0, 0, f"responses/{i}", r, "") for i, r in enumerate(responses) if isinstance(r, dict)]
    return found + [_part(document, 0, 0, f"responses/{jsonwalk.escape(s)}", r) for s, r in views.as_object(responses).items() if isinstance(r, dict)]


def operation_values(corpus: DataFrame, more: str | None = None) -> DataFrame:
    """(spec_source, source, title, pointer, own_key, own_ord, operationId, summary, deprecated, raw, parts) of every operation of a path, from the documents themselves.

    ``more`` says what else is wanted: ``cli`` (``raw`` is the operation's command), ``parameters`` or ``media``: ``parts`` has its own and its path's parameters, or its body and
    responses, and reusable parts of documents are rows without ``own_key``, with their text in ``raw``. What an operation needs lies in its document, so no value is a row and nothing is joined.
    """

    def rows(document: dict) -> Iterator[tuple]:
        for pointer, parent, key, _, _, kind, _, _, _, _, place, _ in jsonwalk.walk(document, False, {"Operation"}, ("pointer",), NO_OPERATIONS):
            if kind != "object" or not pointer.startswith("/paths/"):
                continue
            own = jsonwalk.by_pointer(document, pointer)
            texts = [jsonwalk.scalar_text(own[k]) if k in own and not isinstance(own[k], jsonwalk.NESTED) else None for k in ENDPOINT_KEYS]
            command = own.get("x-cliParam") if more == "cli" else None
            parts = None
            if more == "parameters":
                parts = _parameters(document, own, jsonwalk.by_pointer(document, parent))
            elif more == "media" and pointer.count("/") == 3:
                parts = _bodies(document, own, None)
            yield pointer, key, place, *texts, jsonwalk.compact(command) if isinstance(command, dict) else None, parts
        if more in ("parameters", "media"):
            components = views.as_object(document.get("components"))
            for section in ("parameters", "requestBodies", "responses"):
                for name, value in views.as_object(components.get(section)).items():
                    if isinstance(value, dict):
                        yield f"/components/{section}/{jsonwalk.escape(name)}", None, None, None, None, None, jsonwalk.compact(value), None

    made = document_rows(corpus, f"pointer string, own_key string, own_ord int, {', '.join(f'{k} string' for k in ENDPOINT_KEYS)}, raw string, parts array<{PART}>", rows, ("spec_source", "source", "title"))
    return made.select(*(text_of(F.col(c)).alias(c) if c in ENDPOINT_KEYS else c for c in made.columns))


def first_operations(found: DataFrame, *more: str) -> DataFrame:
    """The columns of ``endpoint_rows`` (``spec_id`` if it is named in ``more``, with others that are wanted as well) of each method and path from operations with source and title: the first by source and order."""
    path = F.replace(F.replace(F.split("pointer", "/")[2], F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    rows = found.select(
        F.concat_ws(":", F.upper("own_key"), path).alias("eid"), F.upper("own_key").alias("method"), path.alias("path"), F.col("title").alias("category"), F.coalesce("operationId", F.lit("")).alias("operation_id"),
        F.coalesce("summary", F.lit("")).alias("summary"), (F.coalesce("deprecated", F.lit("")) == "true").alias("deprecated"), *more, "pointer", "source", "own_ord", *(c for c in ("raw", "parts", "spec_source") if c in found.columns and not more),
    )
    first = Window.partitionBy("eid").orderBy("source", "own_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "source", "own_ord")


def parameter_hint(name: Column, kind: Column, form: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(form.isin("date-time", "date"), F.concat(F.lit("rfc3339-"), form))
        .when(low.isin("filter", "$filter") | low.contains("odata"), "odata-filter")
        .when(low.isin("orderby", "$orderby", "order_by"), "odata-orderby")
        .when((low.contains("csv") | low.endswith("_list") | low.endswith("ids")) & (kind == "string"), "comma-list")
        .when(low.isin("limit", "offset", "page", "page_size"), "pagination")
        .otherwise("")
    )


def body_shape(raw: Column) -> Column:
    """Structure of a schema: an enum is primitive whatever wraps it; any additionalProperties but false is a map."""

    def filled(key: str) -> Column:
        value = F.get_json_object(raw, f"$.{key}")
        return value.isNotNull() & ~value.isin("[]", "{}", "")

    extra = F.get_json_object(raw, "$.additionalProperties")
    kind = F.get_json_object(raw, "$.type")
    return (
        F.when(filled("enum"), "primitive").when(filled("oneOf"), "union-oneOf").when(filled("anyOf"), "union-anyOf").when(filled("allOf"), "allOf-composite").when(filled("properties"), "object")
        .when(extra.startswith("{") | (extra == "true"), "map").when(kind == "object", "object").when(kind == "array", "array").otherwise("primitive")
    )


def component_kind(shape: Column) -> Column:
    return F.when(shape.isin("union-oneOf", "union-anyOf", "allOf-composite"), "union").otherwise(shape)


def component_rows(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, name, kind, shape, body_json) of named schemas, the longest body of each id (ties: first by source); a name that is only referred to is ``unresolved``."""
    own = ast.where("kind = 'Schema' AND parent = '/components/schemas'").join(specs.select("spec_id", "spec_source", "source"), "spec_id")
    named = references(ast).where("ref LIKE '#/components/schemas/%'").join(specs.select("spec_id", "spec_source"), "spec_id")
    return components_of(own, named)


#: Kinds below which no named schema stands, and those below which no other schema of a named one does.
NO_NAMES, NO_SCHEMAS = frozenset(["PathItem", "Schema"]), frozenset(["PathItem", "Extension", "Constraint"])


def named_schemas(corpus: DataFrame) -> DataFrame:
    """(spec_source, source, key, parent, raw) of the named schemas of every document; nothing below them is a row."""
    return flatten(corpus, ("spec_source", "source", "key", "parent", "pointer", "raw"), ("Schema",), NO_NAMES).where("parent = '/components/schemas'")


def unnamed_references(corpus: DataFrame) -> DataFrame:
    """(spec_source, ref): references to schemas, each once for a document, but for those to named schemas of the document itself."""

    def rows(document: dict) -> list[tuple]:
        own = views.as_object(views.as_object(document.get("components")).get("schemas"))
        named = {ref for _, ref in jsonwalk.reference_values(document, False) if isinstance(ref, str) and ref.startswith("#/components/schemas/")}
        return [(ref,) for ref in named if "~" in ref or ref[21:] not in own]

    return document_rows(corpus, "ref string", rows, ("spec_source",))


def components_of(own: DataFrame, named: DataFrame) -> DataFrame:
    """``component_rows`` from schemas (spec_source, source, key, raw) and references (spec_source, ref)."""
    name = F.replace(F.replace("key", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    ids = F.concat_ws(":", "spec_source", F.lit("schemas"), name)
    # equal bodies first become one row: a name that nearly every document defines shuffles once for each different body
    merged = own.groupBy(ids.alias("id"), name.alias("name"), F.col("raw").alias("body_json")).agg(F.min("source").alias("source"))
    best = merged.groupBy("id", "name").agg(F.min_by("body_json", F.struct(-F.length("body_json"), F.col("source"))).alias("body_json"))
    wanted = named.select(F.expr("substring(ref, 22)").alias("name"), "spec_source").select(F.concat_ws(":", "spec_source", F.lit("schemas"), "name").alias("id"), "name").distinct()
    missing = wanted.join(best.select("id"), "id", "left_anti").select("id", "name", F.lit("unresolved").alias("kind"), F.lit("").alias("shape"), F.lit("").alias("body_json"))
    shape = body_shape(F.col("body_json"))
    return best.select("id", "name", component_kind(shape).alias("kind"), shape.alias("shape"), "body_json").unionByName(missing)


def property_rows(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, component_id, name, type, required, read_only, yang_path, ref) of the properties of named schemas."""
    own = ast.where("kind = 'Property'").where(F.col("parent").rlike("^/components/schemas/[^/]+/properties$")).join(specs.select("spec_id", "spec_source"), "spec_id")
    needs = ast.where(F.col("pointer").rlike("^/components/schemas/[^/]+/required/[0-9]+$")).select("spec_id", component_of(F.col("pointer")).alias("component"), text_of(F.col("scalar")).alias("key"), F.lit(True).alias("required")).distinct()
    return property_columns(own.withColumn("component", component_of(F.col("pointer"))).join(needs, ["spec_id", "component", "key"], "left"), "spec_id")


def named_properties(corpus: DataFrame) -> DataFrame:
    """(spec_source, component, key, raw, required) of the properties of named schemas: a schema and what it requires are in one document."""

    def rows(document: dict) -> Iterator[tuple]:
        for name, schema in views.as_object(views.as_object(document.get("components")).get("schemas")).items():
            fields = views.as_object(views.as_object(schema).get("properties"))
            needs = schema.get("required") if fields else None
            needed = {v if isinstance(v, str) else jsonwalk.scalar_text(v) for v in needs if v is not None and not isinstance(v, jsonwalk.NESTED)} if isinstance(needs, list) else ()
            for key, value in fields.items():
                yield jsonwalk.escape(name), key, jsonwalk.compact(value) if isinstance(value, jsonwalk.NESTED) else "", key in needed

    return document_rows(corpus, "component string, key string, raw string, required boolean", rows, ("spec_source",))


def property_columns(rows: DataFrame, *more: str) -> DataFrame:
    """``property_rows`` from properties (spec_source, component, key, raw, required)."""
    component = F.concat_ws(":", "spec_source", F.lit("schemas"), "component")

    def text(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object("raw", p) for p in paths], F.lit(""))

    return rows.select(
        F.concat(component, F.lit("#prop:"), F.col("key")).alias("id"), component.alias("component_id"), F.col("key").alias("name"), text("$.type").alias("type"), F.coalesce("required", F.lit(False)).alias("required"),
        (text("$.readOnly") == "true").alias("read_only"), text("$.x-path", "$['x-path']").alias("yang_path"), text("$.$ref", "$['$ref']").alias("ref"), *more,
    )


def reference_edges(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(a, via, b): named schema to named schema, with the structural keyword the reference stands under."""
    return edges_of_references(references(ast).join(specs.select("spec_id", "spec_source"), "spec_id"))


def edges_of_references(refs: DataFrame) -> DataFrame:
    """``reference_edges`` from references (spec_source, pointer, ref)."""
    refs = refs.where("pointer LIKE '/components/schemas/%' AND ref LIKE '#/components/schemas/%'")
    inner = F.regexp_replace("pointer", r"^/components/schemas/[^/]*", "")
    return refs.select(
        F.concat_ws(":", "spec_source", F.lit("schemas"), component_of(F.col("pointer"))).alias("a"), last_site(inner).alias("via"), F.concat_ws(":", "spec_source", F.lit("schemas"), F.expr("substring(ref, 22)")).alias("b")
    ).distinct()


def check_outcomes(ast: DataFrame, allowed: DataFrame) -> DataFrame:
    """(spec_id, n_unknown, n_unresolved, n_external, degraded) of every document: keys not in ``allowed`` (kind, key), internal references to nothing, references to other files."""
    parents = ast.select("spec_id", F.col("pointer").alias("parent"), F.col("kind").alias("of"))
    keys = ast.where("key IS NOT NULL AND NOT startswith(key, 'x-')").select("spec_id", "parent", "key").join(parents, ["spec_id", "parent"])
    known = allowed.select(F.col("kind").alias("of"), "key")
    unknown = keys.join(F.broadcast(known.select("of").distinct()), "of", "left_semi").join(known, ["of", "key"], "left_anti").groupBy("spec_id").agg(F.count("*").alias("n_unknown"))
    lost = references(ast).where("target IS NULL").groupBy("spec_id").agg(F.count("*").alias("n_unresolved"))
    outside = ast.where("key = '$ref' AND value_type = 'scalar' AND scalar NOT LIKE '\"#%'").groupBy("spec_id").agg(F.count("*").alias("n_external"))
    out = ast.where("pointer = ''").select("spec_id")
    for part in (unknown, lost, outside):
        out = out.join(part, "spec_id", "left")
    return out.na.fill(0).withColumn("degraded", F.expr("n_unknown + n_unresolved > 0"))


def checked(corpus: DataFrame, allowed: DataFrame) -> DataFrame:
    """(spec_source, source, n_unknown, n_unresolved, n_external, degraded) of every document: what ``check_outcomes`` finds among flattened rows.

    A document's keys are counted by the kind of their object where it is read; what is not allowed is found among these counts, and a document's own are summed again.
    """

    def rows(document: dict) -> list[tuple]:
        own = counted_references(document)[1:]
        return [(*own, kind, key, n) for (kind, key), n in jsonwalk.keys_by_kind(document).items()] or [(*own, None, None, 0)]

    known = allowed.select(F.col("kind").alias("of"), "key").distinct()
    uses = document_rows(corpus, "n_unresolved long, n_external long, of string, key string, n long", rows)
    uses = uses.join(F.broadcast(known.select("of", F.lit(True).alias("ruled")).distinct()), "of", "left").join(F.broadcast(known.withColumn("known", F.lit(True))), ["of", "key"], "left")
    unknown = F.coalesce(F.sum(F.when(F.col("ruled") & F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown")
    out = uses.groupBy("spec_source", "source", "n_unresolved", "n_external").agg(unknown)
    return out.select("spec_source", "source", "n_unknown", "n_unresolved", "n_external", F.expr("n_unknown + n_unresolved > 0").alias("degraded"))


def semantic_id(spec: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("sem:"), F.substring(F.sha2(F.concat(spec, F.lit("\0"), kind, F.lit("\0"), key), 256), 1, 24))


#: The columns and kinds of flattened rows that ``semantic_nodes`` reads.
OVERLAY_KEYS = ("spec_id", "pointer", "kind", "value_type", "raw")
OVERLAY_KINDS = ("Operation", "Parameter", "Schema", "Items", "Property", "MediaType", "RequestBody", "Response")


#: Kinds below which there is no overlay node.
NO_OVERLAY = frozenset(["Extension", "Constraint"])


def semantic_nodes(ast: DataFrame) -> DataFrame:
    """(node_id, spec_id, kind, stable_key, pointer): endpoints, parameters, bodies, responses (each media type, of the kind of what holds it), schemas and properties. Schemas that only refer are left out."""
    kinds = F.when(F.col("kind") == "Operation", "Endpoint").when(F.col("kind") == "Items", "Schema").otherwise(F.col("kind"))
    only_ref = F.get_json_object("raw", "$['$ref']").isNotNull() & F.col("kind").isin("Schema", "Items")
    own = ast.where(F.col("kind").isin("Operation", "Parameter", "Schema", "Items", "Property") & (F.col("value_type") == "object")).where(~F.coalesce(only_ref, F.lit(False)))
    media = ast.where("kind = 'MediaType' AND value_type = 'object'").select("spec_id", "pointer", F.regexp_replace("pointer", "/content/[^/]*$", "").alias("holder"))
    holders = ast.where(F.col("kind").isin("RequestBody", "Response") & (F.col("value_type") == "object")).select("spec_id", F.col("pointer").alias("holder"), "kind")
    rows = own.select("spec_id", kinds.alias("kind"), "pointer").unionByName(media.join(holders, ["spec_id", "holder"]).select("spec_id", "kind", "pointer"))
    return rows.select(semantic_id(F.col("spec_id"), F.col("kind"), F.col("pointer")).alias("node_id"), "spec_id", "kind", F.col("pointer").alias("stable_key"), "pointer")


def overlay_rows(corpus: DataFrame) -> DataFrame:
    """(source, node_id, spec_id, kind, stable_key, pointer): ``semantic_nodes`` with their document's source, found where it is read; no text of a value is made."""

    def rows(document: dict, source: str) -> Iterator[tuple]:
        own, holders, media = spec_id(source, document), {}, []
        for pointer, _, _, _, kind, value_type, *_ in jsonwalk.walk(document, False, OVERLAY_KINDS, ("pointer",), NO_OVERLAY):
            if value_type != "object":
                continue
            if kind == "MediaType":
                media.append((re.sub("/content/[^/]*$", "", pointer), pointer))
            elif kind in ("RequestBody", "Response"):
                holders[pointer] = kind
            elif kind not in ("Schema", "Items") or jsonwalk.by_pointer(document, pointer).get("$ref") is None:
                yield own, "Endpoint" if kind == "Operation" else "Schema" if kind == "Items" else kind, pointer
        yield from ((own, holders[holder], pointer) for holder, pointer in media if holder in holders)

    found = document_rows(corpus, "spec_id string, kind string, pointer string", rows, ("source",), named=True)
    return found.select("source", semantic_id(F.col("spec_id"), F.col("kind"), F.col("pointer")).alias("node_id"), "spec_id", "kind", F.col("pointer").alias("stable_key"), "pointer")


def has_overlay(document: dict) -> bool:
    """Whether ``semantic_nodes`` has a node of a document."""
    holders, media = set(), []
    for pointer, _, _, _, kind, value_type, *_ in jsonwalk.walk(document, False, OVERLAY_KINDS, ("pointer",), NO_OVERLAY):
        if value_type != "object":
            continue
        if kind in ("Operation", "Parameter", "Property") or (kind in ("Schema", "Items") and jsonwalk.by_pointer(document, pointer).get("$ref") is None):
            return True
        if kind == "MediaType":
            media.append(re.sub("/content/[^/]*$", "", pointer))
        elif kind in ("RequestBody", "Response"):
            holders.add(pointer)
    return any(holder in holders for holder in media)


def carried(corpus: DataFrame) -> DataFrame:
    """``carry_through`` of a corpus that is not flattened: what became of a document is found where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1).to_pylist():
                document = parsed(raw)
                found.append((0, 0, 0) if document is None else (1, int(counted_references(document)[1] > 0), int(has_overlay(document))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))] if found else [batch.column(0)] + [pa.array([], pa.int64())] * 3, names=["spec_source", "read", "lost", "over"])

    each = corpus.select("spec_source", "raw").mapInArrow(run, "spec_source string, read long, lost long, over long")
    return ratios(each.groupBy("spec_source").agg(F.count("*").alias("n_raw"), F.sum("read").alias("n_read"), F.sum("lost").alias("n_unresolved"), F.sum("over").alias("n_overlay")))


def carry_through(corpus: DataFrame, ast: DataFrame) -> DataFrame:
    """(spec_source, n_raw, n_failed, n_resolved, n_unresolved, n_overlay, resolved_ratio, overlay_ratio): what became of the documents of each provider.

    Failed: not a JSON object. Resolved: every internal reference names something. Overlay: it has at least one overlay node. Ratios are
    of all raw documents, to four places. ``ast`` is the flattened corpus.
    """
    lost = references(ast).where("target IS NULL").select("spec_id").distinct().withColumn("lost", F.lit(1))
    overlay = semantic_nodes(ast).select("spec_id").distinct().withColumn("over", F.lit(1))
    each = spec_rows(corpus).select("spec_id", "spec_source").join(lost, "spec_id", "left").join(overlay, "spec_id", "left")
    read = each.groupBy("spec_source").agg(F.count("*").alias("n_read"), F.count("lost").alias("n_unresolved"), F.count("over").alias("n_overlay"))
    return ratios(corpus.groupBy("spec_source").agg(F.count("*").alias("n_raw")).join(read, "spec_source", "left").na.fill(0))


def ratios(joined: DataFrame) -> DataFrame:
    """``carry_through`` from (spec_source, n_raw, n_read, n_unresolved, n_overlay)."""
    resolved = F.col("n_read") - F.col("n_unresolved")
    return joined.select(
        "spec_source", "n_raw", (F.col("n_raw") - F.col("n_read")).alias("n_failed"), resolved.alias("n_resolved"), "n_unresolved", "n_overlay",
        F.round(resolved / F.col("n_raw"), 4).alias("resolved_ratio"), F.round(F.col("n_overlay") / F.col("n_raw"), 4).alias("overlay_ratio"),
    )


def decode_blob(stored: Column, mark: str = "b64:") -> Column:
    """Text kept as base64 behind a mark; what does not decode stays as it is."""
    decoded = F.try_validate_utf8(F.try_to_binary(F.expr("substring(stored, 5)") if mark == "b64:" else stored, F.lit("base64")).cast("string"))
    return F.when(stored.startswith(mark), F.coalesce(decoded, stored)).otherwise(F.coalesce(stored, F.lit("")))


def endpoint_projections(corpus: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(source, method, path, skeleton, components, glossary, required, n_components) of every operation, as JSON text; ``required`` joins its required paths.

    ``columns``: those wanted (all, if not given); a Python step cannot be pruned by Spark, so the others are not made.
    """
    types = {"source": pa.string(), "method": pa.string(), "path": pa.string(), "skeleton": pa.string(), "components": pa.string(), "glossary": pa.string(), "required": pa.string(), "n_components": pa.int64()}
    names = list(types) if columns is None else list(columns)
    made = {
        "skeleton": lambda seen, path, method: jsonwalk.compact(seen.skeleton(path, method)),
        "components": lambda seen, path, method: jsonwalk.compact(seen.components(path, method)),
        "glossary": lambda seen, path, method: jsonwalk.compact(seen.glossary(path, method)),
        "required": lambda seen, path, method: ",".join(seen.required(path, method)),
        "n_components": lambda seen, path, method: sum(map(len, seen.inner(path, method).values())),
    }
    wanted = [(name, f) for name, f in made.items() if name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document, rows = parsed(raw) or {}, []
                seen = views.Views(document)
                for path, item in views.as_object(document.get("paths")).items():
                    for method in (m for m in views.as_object(item) if m in jsonwalk.METHODS):
                        rows.append({"source": source, "method": method.upper(), "path": path} | {name: f(seen, path, method) for name, f in wanted})
                yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], types[name]) for name in names], names=names)

    return corpus.select("source", "raw").mapInArrow(run, ", ".join(f"{name} {'long' if name == 'n_components' else 'string'}" for name in names))
