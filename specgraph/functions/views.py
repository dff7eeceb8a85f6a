"""What a caller sees of one operation: skeleton, component bodies, glossary and required paths.

The views of a document's operations share what they have in common: which components a component refers to, its body without prose, its
prose, its index entry and its required paths are found once for a document. Odd shapes (a text where an object belongs) count as absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from specgraph.functions.jsonwalk import PROSE, followed, references, without_prose

# Keywords below which prose is looked for; success statuses by rank; media types by rank; references followed below each other.
BELOW = ("properties", "patternProperties", "items", "additionalProperties", "allOf", "oneOf", "anyOf", "schema")
SUCCESS = ("200", "201", "204", "202")
MEDIA = ("application/json", "application/merge-patch+json")
DEPTH = 15


def as_object(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def only_prose(value: Any) -> Any:
    """The prose that ``without_prose`` leaves out, in place and if it is not empty; list positions are kept; None if there is none."""
    if isinstance(value, list):
        items = [only_prose(v) for v in value]
        return items if any(i is not None for i in items) else None
    if not isinstance(value, dict):
        return None
    found = {}
    for k, v in value.items():
        if k in PROSE:
            part = None if (isinstance(v, str) and not v.strip()) or v in ([], {}) else (v,)
            if part:
                found[k] = v
        elif k in ("properties", "patternProperties") and isinstance(v, dict):
            named = {name: p for name, body in v.items() if (p := only_prose(body)) is not None}
            if named:
                found[k] = named
        elif k in BELOW and (part := only_prose(v)) is not None:
            found[k] = part
    return found or None


def pick_media(content: Any) -> tuple[str, Any]:
    """(media type, schema): the best ranked, else the first; no schema if the entry is no object."""
    content = as_object(content)
    name = next((m for m in MEDIA if m in content), next(iter(content), ""))
    return name, as_object(content.get(name)).get("schema")


def index_entry(body: Any) -> dict:
    """type, format, enum, required, union flags, item reference of an array and sorted child references of a component."""
    body = as_object(body)
    entry = {k: body[k] for k in ("type", "format") if k in body}
    if isinstance(body.get("enum"), list) and body["enum"]:
        entry["enum"] = body["enum"]
    if isinstance(body.get("required"), list) and body["required"]:
        entry["required"] = [r for r in body["required"] if isinstance(r, str)]
    entry |= {k: True for k in ("oneOf", "anyOf", "allOf") if isinstance(body.get(k), list) and body[k]}
    if body.get("type") == "array" and "$ref" in as_object(body.get("items")):
        entry["items_ref"] = body["items"]["$ref"]
    children = sorted(set(references(body)))
    return entry | ({"child_refs": children} if children else {})


class Views:
    """Views of the operations of one document."""

    def __init__(self, document: dict):
        self.document = document
        self._children: dict[str, list[str]] = {}
        self._made: dict[tuple[str, str], Any] = {}
        self._paths: dict[tuple[str, int], list[str]] = {}
        self._named: dict[str, Any] = {}
        self._inner: dict[tuple[str, str], dict[str, dict[str, str]]] = {}

    def followed(self, ref: str) -> Any:
        """What a reference names, found once."""
        if ref not in self._named:
            self._named[ref] = followed(self.document, ref)
        return self._named[ref]

    def operation(self, path: str, method: str) -> dict:
        return as_object(as_object(as_object(self.document.get("paths")).get(path)).get(method))

    def target(self, value: Any) -> dict:
        """An object, or the one that it refers to."""
        if isinstance(value, dict) and isinstance(value.get("$ref"), str):
            named = self.followed(value["$ref"])
            value = named if isinstance(named, dict) else value
        return as_object(value)

    def reached(self, value: Any) -> dict[str, dict[str, str]]:
        """Section to name to reference of every component that a value reaches, sorted."""
        seen: set[str] = set()
        todo = list(references(value))
        while todo:
            ref = todo.pop()
            if ref in seen or ref.count("/") < 3 or self.followed(ref) is None:
                continue
            seen.add(ref)
            if ref not in self._children:
                self._children[ref] = list(references(self.followed(ref)))
            todo += self._children[ref]
        out: dict[str, dict[str, str]] = {}
        for ref in sorted(seen):
            section, name = ref.split("/")[2:4]
            out.setdefault(section, {})[name] = ref
        return out

    def of_component(self, view: Any, ref: str) -> Any:
        """A view (``without_prose``, ``only_prose``, ``index_entry``) of a component, made once."""
        key = (view.__name__, ref)
        if key not in self._made:
            self._made[key] = view(self.followed(ref))
        return self._made[key]

    def parameters(self, operation: dict) -> list[dict]:
        given = operation.get("parameters")
        return [self.target(p) for p in given if isinstance(p, dict)] if isinstance(given, list) else []

    def inputs(self, operation: dict) -> dict:
        return {k: operation.get(k) for k in ("parameters", "requestBody", "responses")}

    def required_paths(self, schema: Any, depth: int = 0) -> list[str]:
        """Dot paths (``a.b``, ``a[].b``) of required leaves, in order, as though all references were expanded; also below objects and arrays that are not required themselves."""
        ref = None
        while isinstance(schema, dict) and isinstance(schema.get("$ref"), str):
            named = self.followed(schema["$ref"])
            if named is None:
                break
            ref, schema, depth = schema["$ref"], named, depth + 1
            if depth > DEPTH:
                return []
        if ref is not None and (ref, depth) in self._paths:
            return self._paths[ref, depth]
        found = list(self._required(as_object(schema), depth))
        if ref is not None:
            self._paths[ref, depth] = found
        return found

    def seen_kind(self, value: Any, depth: int) -> tuple[Any, dict]:
        """A member's type, and the member itself, behind its references."""
        while isinstance(value, dict) and isinstance(value.get("$ref"), str) and (named := self.followed(value["$ref"])) is not None:
            value, depth = named, depth + 1
            if depth > DEPTH:
                return None, {}
        return as_object(value).get("type"), as_object(value)

    def _required(self, schema: dict, depth: int) -> Iterator[str]:
        members, names = as_object(schema.get("properties")), schema.get("required")
        needed = [n for n in names if isinstance(n, str)] if isinstance(names, list) else []
        optional = [n for n in members if n not in needed]
        for name, must in [*((n, True) for n in needed), *((n, False) for n in optional)]:
            kind, body = self.seen_kind(members.get(name), depth)
            below, path = [], name
            if kind == "object":
                below = self.required_paths(members[name], depth)
            elif kind == "array" and self.seen_kind(body.get("items"), depth)[1]:
                # the items stand below the array, so their references count from where the array was found
                below, path = self.required_paths(body["items"], self.depth_of(members[name], depth)), f"{name}[]"
            yield from [f"{path}.{x}" for x in below] or ([name] if must else [])

    def depth_of(self, value: Any, depth: int) -> int:
        while isinstance(value, dict) and isinstance(value.get("$ref"), str) and (named := self.followed(value["$ref"])) is not None:
            value, depth = named, depth + 1
        return depth

    def outcomes(self, responses: Any) -> dict:
        """The schema of the best success response under its status, and the first error that is a reference under ``error``."""
        given = {str(s): r for s, r in as_object(responses).items()}
        best = next((s for s in SUCCESS if s in given), next((s for s in given if s.startswith("2")), None))
        found = {} if best is None else {best: {"schema": without_prose(pick_media(self.target(given[best]).get("content"))[1])}}
        errors = ({"status": s, "$ref": r["$ref"]} for s, r in given.items() if s[:1] in ("4", "5") and isinstance(r, dict) and "$ref" in r)
        return found | {"error": e for e in [next(errors, None)] if e}

    def skeleton(self, path: str, method: str) -> dict:
        """What a caller must know of an operation, without prose but for its summary; components are an index by section and name."""
        op = self.operation(path, method)
        kept = {"name": "", "in": "", "required": False, "schema": {}}
        body = self.target(op.get("requestBody"))
        media, schema = pick_media(body.get("content"))
        tags = op.get("tags")
        head = {"method": method.upper(), "path": path, "summary": op.get("summary") or "", "operation_id": op.get("operationId") or "", "tags": tags if isinstance(tags, list) else [], "deprecated": bool(op.get("deprecated"))}
        shape = head | {
            "parameters": [without_prose({k: p.get(k, empty) or empty for k, empty in kept.items()}) for p in self.parameters(op)],
            "request_body": None if schema is None else {"content_type": media, "schema": without_prose(schema), "required": body.get("required", False)},
            "required_paths": self.required_paths(schema),
            "responses": self.outcomes(op.get("responses")),
        }
        return shape | {"$components_index": {s: {n: self.of_component(index_entry, r) for n, r in names.items()} for s, names in self.reached(shape).items()}}

    def inner(self, path: str, method: str) -> dict[str, dict[str, str]]:
        """Section to name to reference of all components that an operation reaches."""
        if (path, method) not in self._inner:
            self._inner[path, method] = self.reached(self.inputs(self.operation(path, method)))
        return self._inner[path, method]

    def components(self, path: str, method: str) -> dict:
        """Bodies without prose of all components that an operation reaches, by section and name."""
        return {s: {n: self.of_component(without_prose, r) for n, r in names.items()} for s, names in self.inner(path, method).items()}

    def required(self, path: str, method: str) -> list[str]:
        """Required paths of an operation's body."""
        return self.required_paths(pick_media(self.target(self.operation(path, method).get("requestBody")).get("content"))[1])

    def glossary(self, path: str, method: str) -> dict:
        """The prose of an operation: its description, that of its named parameters with their place, of the schemas that it reaches and of a body's own schema."""
        op = self.operation(path, method)
        found: dict[str, Any] = {"method": method.upper(), "path": path}
        if isinstance(op.get("description"), str) and op["description"].strip():
            found["description"] = op["description"]
        named = {p["name"]: prose | {"in": p.get("in") or ""} for p in self.parameters(op) if isinstance(p.get("name"), str) and p["name"] and (prose := only_prose(p))}
        if named:
            found["parameters"] = named
        parts = {n: prose for n, r in self.inner(path, method).get("schemas", {}).items() if (prose := self.of_component(only_prose, r))}
        _, schema = pick_media(as_object(op.get("requestBody")).get("content"))
        if isinstance(schema, dict) and "$ref" not in schema and (prose := only_prose(schema)):
            parts["requestBody"] = prose
        return found | {"components": parts}
