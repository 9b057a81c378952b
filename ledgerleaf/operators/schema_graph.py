"""A JSON Schema as a graph: checked for its shape, its references resolved by URI, its recursion found.

Everything here happens on the driver, once, when a request is made. A schema belongs to the resource of the nearest
``$id`` around it; ``$ref`` leads to a resource, to a pointer or an anchor in one. ``$dynamicRef`` leads to the anchor of
the outermost resource that validation has passed through, so a place in the graph is a schema and the resources passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urldefrag, urljoin

from ledgerleaf.functions.regex import RegexError, java_regex

TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
HOLD_SCHEMA = ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else", "unevaluatedItems", "unevaluatedProperties")
HOLD_LIST = ("prefixItems", "allOf", "anyOf", "oneOf")
HOLD_MEMBERS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")


class SchemaRequestError(ValueError):
    """A request that no extraction may start with."""


def schema_path(parts: tuple[str, ...]) -> str:
    """JSON pointer of a place in the schema."""
    return "#" + "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")


def _is_count(x: object) -> bool:
    return _is_number(x) and x == int(x) and x >= 0


def _is_names(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(n, str) for n in x) and len(set(x)) == len(x)


def _is_regex(x: object) -> bool:
    try:
        return isinstance(x, str) and java_regex(x) is not None
    except RegexError:
        return False


def _is_type(x: object) -> bool:
    return x in TYPES if isinstance(x, str) else _is_names(x) and bool(x) and set(x) <= set(TYPES)


def _is_anchor(x: object) -> bool:
    return isinstance(x, str) and bool(x) and (x[0] == "_" or x[0].isascii() and x[0].isalpha()) and all(c.isascii() and (c.isalnum() or c in "-._") for c in x)


#: What the value of each keyword must be; keywords that hold schemas stand above.
SHAPES: dict[str, Callable[[object], bool]] = {
    "type": _is_type,
    "enum": lambda x: isinstance(x, list),
    "multipleOf": lambda x: _is_number(x) and x > 0,
    "required": _is_names,
    "dependentRequired": lambda x: isinstance(x, dict) and all(map(_is_names, x.values())),
    "pattern": _is_regex,
    "$id": lambda x: isinstance(x, str) and not urldefrag(x)[1],
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _is_number),
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minContains", "maxContains", "minProperties", "maxProperties"), _is_count),
    **dict.fromkeys(("uniqueItems", "deprecated", "readOnly", "writeOnly"), lambda x: isinstance(x, bool)),
    **dict.fromkeys(("$anchor", "$dynamicAnchor"), _is_anchor),
    **dict.fromkeys(("$ref", "$dynamicRef", "$schema", "$comment", "title", "description", "format", "contentEncoding", "contentMediaType"), lambda x: isinstance(x, str)),
    "examples": lambda x: isinstance(x, list),
}


def check_schema(schema: object, at: tuple[str, ...] = ()) -> None:
    """Raise SchemaRequestError unless a schema is well formed by Draft 2020-12, all its parts included."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise SchemaRequestError(f"{schema_path(at)} is no schema")
    for word, value in schema.items():
        here = (*at, word)
        if word in SHAPES and not SHAPES[word](value):
            raise SchemaRequestError(f"{schema_path(here)} is malformed")
        if word in HOLD_SCHEMA:
            check_schema(value, here)
        elif word in HOLD_LIST:
            if not isinstance(value, list) or not value:
                raise SchemaRequestError(f"{schema_path(here)} must be a list of schemas")
            for k, part in enumerate(value):
                check_schema(part, (*here, str(k)))
        elif word in HOLD_MEMBERS:
            if not isinstance(value, dict) or (word == "patternProperties" and not all(map(_is_regex, value))):
                raise SchemaRequestError(f"{schema_path(here)} must hold schemas by name")
            for name, part in value.items():
                check_schema(part, (*here, name))


def parts_of(schema: object) -> Iterator[object]:
    """The schemas directly inside a schema."""
    if not isinstance(schema, dict):
        return
    for word, value in schema.items():
        if word in HOLD_SCHEMA:
            yield value
        elif word in HOLD_LIST:
            yield from value
        elif word in HOLD_MEMBERS:
            yield from value.values()


class SchemaGraph:
    def __init__(self, root: dict) -> None:
        self.root = root
        self.bases: dict[int, str] = {}
        self.resources: dict[str, object] = {"": root}
        self.anchors: dict[tuple[str, str], object] = {}
        self.dynamic: dict[tuple[str, str], object] = {}
        self._index(root, "")
        self._leads: dict[int, bool] = {}

    def _index(self, schema: object, base: str) -> None:
        if isinstance(schema, dict):
            if "$id" in schema:
                base = urljoin(base, schema["$id"])
                self.resources[base] = schema
            for word, table in (("$anchor", self.anchors), ("$dynamicAnchor", self.anchors), ("$dynamicAnchor", self.dynamic)):
                if word in schema:
                    table[base, schema[word]] = schema
        self.bases[id(schema)] = base
        for part in parts_of(schema):
            self._index(part, base)

    def base(self, schema: object) -> str:
        return self.bases.get(id(schema), "")

    def resolve(self, schema: dict, ref: str) -> object:
        """What ``ref`` in ``schema`` leads to."""
        base = self.base(schema)
        uri, fragment = urldefrag(base + ref if ref.startswith("#") else urljoin(base, ref))
        fragment = unquote(fragment)
        if uri not in self.resources:
            raise SchemaRequestError(f"{ref} leaves the schema")
        target = self.resources[uri]
        if fragment and not fragment.startswith("/"):
            if (uri, fragment) not in self.anchors:
                raise SchemaRequestError(f"{ref} leads nowhere")
            return self.anchors[uri, fragment]
        for part in fragment.split("/")[1:]:
            key = part.replace("~1", "/").replace("~0", "~")
            try:
                target = target[int(key) if isinstance(target, list) else key]  # type: ignore[index]
            except (KeyError, TypeError, ValueError, IndexError):
                raise SchemaRequestError(f"{ref} leads nowhere") from None
            if id(target) not in self.bases:
                self._index(target, uri)
        if not isinstance(target, (dict, bool)):
            raise SchemaRequestError(f"{ref} is no schema")
        return target

    def enter(self, schema: object, scope: tuple[str, ...]) -> tuple[str, ...]:
        """The resources passed once ``schema`` is reached, each where it was first."""
        base = self.base(schema)
        return scope if base in scope else (*scope, base)

    def resolve_dynamic(self, schema: dict, ref: str, scope: tuple[str, ...]) -> object:
        target = self.resolve(schema, ref)
        name = unquote(urldefrag(ref)[1])
        if isinstance(target, dict) and target.get("$dynamicAnchor") == name:
            return next((self.dynamic[base, name] for base in scope if (base, name) in self.dynamic), target)
        return target

    def _next(self, schema: object) -> Iterator[object]:
        yield from parts_of(schema)
        if isinstance(schema, dict):
            if "$ref" in schema:
                yield self.resolve(schema, schema["$ref"])
            if "$dynamicRef" in schema:
                yield self.resolve(schema, schema["$dynamicRef"])
                name = unquote(urldefrag(schema["$dynamicRef"])[1])
                yield from (x for (_, n), x in self.dynamic.items() if n == name)

    def _reached(self, schema: object) -> dict[int, object]:
        found: dict[int, object] = {}
        todo = [schema]
        while todo:
            for x in self._next(todo.pop()):
                if id(x) not in found:
                    found[id(x)] = x
                    todo.append(x)
        return found

    def recursive(self, schema: object) -> bool:
        """Whether a schema can be reached from itself or from one that leads to itself."""
        if id(schema) not in self._leads:
            reached = {id(schema): schema, **self._reached(schema)}
            self._leads[id(schema)] = any(k in self._reached(x) for k, x in reached.items())
        return self._leads[id(schema)]

    def branching(self) -> int:
        """How many references to recursive schemas there are."""
        places = [self.root, *self._reached(self.root).values()]
        return sum(1 for x in places if isinstance(x, dict) for word in ("$ref", "$dynamicRef") if word in x and self.recursive(self.resolve(x, x[word])))
