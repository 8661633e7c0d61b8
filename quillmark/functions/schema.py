"""JSON schemas compiled to column expressions: what a document breaks, found without Python.

A schema becomes one expression over a VARIANT: types, enum, const, pattern,
lengths, bounds, required and closed properties, items and their numbers,
allOf, anyOf, oneOf, not, if/then/else, and references inside the schema. Keywords
that only describe are passed over; others that would decide are refused, so that no rule is lost in silence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "deprecated", "readOnly", "writeOnly"}
KEYWORDS = {
    "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "required", "properties", "additionalProperties",
    "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref",
}
#: References that may stand inside each other; a schema that refers to itself has no finite expression.
DEEPEST = 12
_NONE = lambda: F.array().cast("array<string>")
#: Keywords whose schemas look at the same value.
_SAME, _SAME_LISTS = ("not", "if", "then", "else"), ("allOf", "anyOf", "oneOf")
_COMBINED = ("anyOf", "oneOf", "not")
_NUMERIC = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
_OF_OBJECTS = {"required", "properties", "additionalProperties", "minProperties", "maxProperties"}
_OF_ARRAYS = {"items", "minItems", "maxItems", "uniqueItems"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _in(x: Column, values: list) -> Column:
    """x among a few values, by a lookup: isin, where it isn't compiled, leaves its loop by an exception for each hit."""
    values = list(dict.fromkeys(values))
    if len(values) == 1:
        return x == values[0]
    return F.try_element_at(F.create_map(*[F.lit(y) for v in values for y in (v, True)]), x).isNotNull() if len(values) <= 10 else x.isin(*values)


def _json(v: Column) -> Column:
    return F.to_json(v)


class _Value:
    """A value and the parts of it that its schemas look at, each found once for all of them; members that have no members of their own are beside it."""

    def __init__(self, bound: Column, parts: set[str], members: dict[str, _Value] | None = None):
        part = lambda name: bound[name] if name in parts else None
        self.v, self.number, self.entries, self.items = bound["v"], part("number"), part("entries"), part("items")
        self.members = members or {}
        # A description of a value with parts describes all of them: it is asked for only where the value has none.
        whole = [x for x in (self.entries, self.items) if x is not None]
        self.shape = F.when(reduce(or_, (x.isNotNull() for x in whole)), "PARTS").otherwise(F.schema_of_variant(self.v)) if whole else bound["shape"]

    @staticmethod
    def found(value: Column, parts: set[str]) -> Column:
        get = {"number": "double", "entries": "map<string,variant>", "items": "array<variant>"}
        columns = [F.try_variant_get(value, "$", t).alias(name) for name, t in get.items() if name in parts]
        return F.struct(value.alias("v"), *columns, *([] if parts & {"entries", "items"} else [F.schema_of_variant(value).alias("shape")]))

    @staticmethod
    def bind(value: Column, parts: set[str], members: dict[str, set[str]], use: Callable[[_Value], Column]) -> Column:
        def beside(s: Column) -> Column:
            each = [_Value.found(F.try_element_at(s["entries"], F.lit(name)), of).alias(f"m{i}") for i, (name, of) in enumerate(members.items())]
            return _let(F.struct(*each), lambda m: use(_Value(s, parts, {name: _Value(m[f"m{i}"], of) for i, (name, of) in enumerate(members.items())})))

        return _let(_Value.found(value, parts), beside if members else lambda s: use(_Value(s, parts)))

    def get(self, t: str) -> Column:
        return F.try_variant_get(self.v, "$", t)

    def is_(self, kind: str) -> Column:
        """Whether it is an object, array, string, boolean, integer, number (any one) or null."""
        if kind == "object":
            return self.entries.isNotNull()
        if kind == "array":
            return self.items.isNotNull()
        if kind not in ("integer", "number"):
            return self.shape == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}.get(kind, kind)
        numeric = (self.shape == "BIGINT") | self.shape.startswith("DECIMAL") | (self.shape == "DOUBLE")
        number = self.get("double") if self.number is None else self.number
        return numeric if kind == "number" else (self.shape == "BIGINT") | numeric & (number == F.floor(number))


class Compiler:
    """Expressions of one schema document.

    What is repeated for each value is kept small, since Spark doesn't compile what stands in a lambda: a value's parts are found once,
    paths are put together only for what is broken, and a schema that only has to hold ends at the first thing that doesn't.
    """

    def __init__(self, schema: dict):
        self.root = schema

    def resolve(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"a reference outside the schema: {ref}")
        at = self.root
        for part in ref[1:].strip("/").split("/") if ref != "#" else []:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def same(self, schema: Any, depth: int) -> Iterator[tuple[dict, int]]:
        """The schemas that look at one value: this one and those in it that aren't about members or items."""
        if isinstance(schema, bool):
            return
        yield schema, depth
        for part in [*(schema[k] for k in _SAME if k in schema), *(p for k in _SAME_LISTS for p in schema.get(k, []))]:
            yield from self.same(part, depth)
        if "$ref" in schema:
            yield from self.same(self._referred(schema, depth), depth + 1)

    def parts(self, schema: Any, depth: int) -> set[str]:
        """The parts of a value that those schemas ask for."""
        found = set()
        for s, _ in self.same(schema, depth):
            named = {s["type"]} if isinstance(s.get("type"), str) else set(s.get("type", []))
            listed = [*s.get("enum", []), s.get("const")]
            found |= {"number"} if _NUMERIC & set(s) or any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in listed) else set()
            found |= {"entries"} if _OF_OBJECTS & set(s) or "object" in named else set()
            found |= {"items"} if _OF_ARRAYS & set(s) or "array" in named else set()
        return found

    def members(self, schema: Any, depth: int) -> dict[str, set[str]]:
        """Named members that no schema asks for members, with the parts that are asked for."""
        found: dict[str, set[str]] = {}
        for s, d in self.same(schema, depth):
            for name, part in self._named(s).items():
                found[name] = found.get(name, set()) | self.parts(part, d)
        return {name: parts for name, parts in found.items() if "entries" not in parts}

    def _named(self, schema: dict) -> dict:
        return {name: part for name, part in schema.get("properties", {}).items() if part is False or part is not True and set(part) - NOTES}

    def _referred(self, schema: dict, depth: int) -> Any:
        if depth >= DEEPEST:
            raise ValueError(f"references deeper than {DEEPEST}: {schema['$ref']}")
        return self.resolve(schema["$ref"])

    def _bind(self, schema: Any, value: Column, depth: int, use: Callable[[_Value], Column]) -> Column:
        return _Value.bind(value, self.parts(schema, depth), self.members(schema, depth), use)

    def violations(self, schema: Any, value: Column, path: Column, depth: int = 0) -> Column:
        """array<string> of "path keyword" for a value that is there, among nulls."""
        if isinstance(schema, bool):
            return _NONE() if schema else F.array(F.concat(path, F.lit(" false")))
        return self._bind(schema, value, depth, lambda x: self._together(self._broken(schema, x, path, depth))) if set(schema) - NOTES else _NONE()

    def holds(self, schema: Any, value: Column, depth: int) -> Column:
        """Whether a value that is there breaks nothing."""
        if isinstance(schema, bool):
            return F.lit(schema)
        return self._bind(schema, value, depth, lambda x: self._valid(schema, x, depth)) if set(schema) - NOTES else F.lit(True)

    @staticmethod
    def _together(pieces: list[tuple[bool, Column]]) -> Column:
        """One array of single texts and arrays of them, in order."""
        arrays: list[Column] = []
        for single, run in groupby(pieces, lambda p: p[0]):
            columns = [c for _, c in run]
            arrays += [F.array(*columns)] if single else columns
        return F.concat(*arrays) if len(arrays) > 1 else arrays[0] if arrays else _NONE()

    def _broken(self, schema: Any, x: _Value, path: Column, depth: int) -> list[tuple[bool, Column]]:
        """What a value breaks: (True, a text or null) or (False, an array of them)."""
        if isinstance(schema, bool):
            return [] if schema else [(True, F.concat(path, F.lit(" false")))]
        found: list[tuple[bool, Column]] = []
        if "$ref" in schema:
            found += self._broken(self._referred(schema, depth), x, path, depth + 1)
        rules = [(keyword, (True, F.when(~ok, F.concat(path, F.lit(f" {keyword}"))))) for keyword, ok in self._rules(schema, x, depth)]
        found += [broken for keyword, broken in rules if keyword not in _COMBINED]
        found += self._members(schema, x, path, depth)
        if "items" in schema:
            each = lambda item, i: self.violations(schema["items"], item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth)
            found.append((False, F.when(x.items.isNotNull(), F.flatten(F.transform(x.items, each))).otherwise(_NONE())))
        for part in schema.get("allOf", []):
            found += self._broken(part, x, path, depth)
        found += [broken for keyword, broken in rules if keyword in _COMBINED]
        if "if" in schema:
            test = self._valid(schema["if"], x, depth)
            yes, no = (self._broken(schema.get(k, True), x, path, depth) for k in ("then", "else"))
            single = len(yes) < 2 and len(no) < 2 and all(one for one, _ in yes + no)
            if single and yes + no:
                nothing = [(True, F.lit(None).cast("string"))]
                found.append((True, F.when(test, (yes or nothing)[0][1]).otherwise((no or nothing)[0][1])))
            elif yes + no:
                found.append((False, F.when(test, self._together(yes)).otherwise(self._together(no))))
        return found

    def _valid(self, schema: Any, x: _Value, depth: int) -> Column:
        if isinstance(schema, bool):
            return F.lit(schema)
        found = [self._valid(self._referred(schema, depth), x, depth + 1)] if "$ref" in schema else []
        found += [ok for _, ok in self._rules(schema, x, depth)]
        if {"required", "properties", "additionalProperties"} & set(schema):
            found.append(x.entries.isNull() | self._members_hold(schema, x, depth))
        if "items" in schema:
            found.append(F.coalesce(F.forall(x.items, lambda item: self.holds(schema["items"], item, depth)), F.lit(True)))
        found += [self._valid(part, x, depth) for part in schema.get("allOf", [])]
        if "if" in schema:
            yes, no = (self._valid(schema.get(k, True), x, depth) for k in ("then", "else"))
            found.append(F.when(self._valid(schema["if"], x, depth), yes).otherwise(no))
        return reduce(and_, found) if found else F.lit(True)

    def _rules(self, schema: dict, x: _Value, depth: int) -> list[tuple[str, Column]]:
        """Keywords that a value keeps or breaks as a whole, with whether it keeps them."""
        unknown = set(schema) - KEYWORDS - NOTES
        if unknown:
            raise ValueError(f"keywords that aren't compiled: {sorted(unknown)}")
        found: list[tuple[str, Column]] = []

        def unless(ok: Column, keyword: str) -> None:
            found.append((keyword, F.coalesce(ok, F.lit(False))))

        if "type" in schema:
            named = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            unless(reduce(or_, map(x.is_, named)), "type")
        for keyword in ("enum", "const"):
            if keyword in schema:
                unless(self._one_of(x, schema[keyword] if keyword == "enum" else [schema[keyword]]), keyword)
        bounds = {
            "pattern": ("string", lambda n: F.rlike(x.get("string"), n)),
            "minLength": ("string", lambda n: F.length(x.get("string")) >= n), "maxLength": ("string", lambda n: F.length(x.get("string")) <= n),
            "minimum": ("number", lambda n: x.number >= n), "maximum": ("number", lambda n: x.number <= n), "exclusiveMinimum": ("number", lambda n: x.number > n), "exclusiveMaximum": ("number", lambda n: x.number < n),
            "multipleOf": ("number", lambda n: x.number % n == 0),
            "minItems": ("array", lambda n: F.size(x.items) >= n), "maxItems": ("array", lambda n: F.size(x.items) <= n),
            "minProperties": ("object", lambda n: F.size(x.entries) >= n), "maxProperties": ("object", lambda n: F.size(x.entries) <= n),
        }
        for keyword, (kind, test) in bounds.items():
            if keyword in schema:
                unless(~x.is_(kind) | test(F.lit(schema[keyword])), keyword)
        if schema.get("uniqueItems"):
            texts = F.transform(x.items, _json)
            unless(~x.is_("array") | (F.size(F.array_distinct(texts)) == F.size(texts)), "uniqueItems")
        for keyword, test in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if keyword in schema:
                unless(test(sum((self._valid(p, x, depth).cast("int") for p in schema[keyword]), F.lit(0))), keyword)
        if "not" in schema:
            unless(~self._valid(schema["not"], x, depth), "not")
        return found

    def _members(self, schema: dict, x: _Value, path: Column, depth: int) -> list[tuple[bool, Column]]:
        found = [(True, F.when(x.entries.isNotNull() & self._at(x, name).isNull(), F.concat(path, F.lit(f".{name} required")))) for name in schema.get("required", [])]
        for name, part in self._named(schema).items():
            there, at = self._at(x, name).isNotNull(), F.concat(path, F.lit(f".{name}"))
            if name in x.members:
                found += [(single, F.when(there, c).otherwise(F.lit(None).cast("string") if single else _NONE())) for single, c in self._broken(part, x.members[name], at, depth)]
            else:
                found.append((False, F.when(there, self.violations(part, self._at(x, name), at, depth)).otherwise(_NONE())))
        more, named = schema.get("additionalProperties", True), list(schema.get("properties", {}))
        if more is not True and more != {}:
            if more is False:
                names = F.filter(F.map_keys(x.entries), lambda k: ~_in(k, named)) if named else F.map_keys(x.entries)
                others = F.transform(names, lambda k: F.concat(path, F.lit("."), k, F.lit(" false")))
            else:
                rest = F.map_filter(x.entries, lambda k, _: ~_in(k, named)) if named else x.entries
                others = F.flatten(F.transform(F.map_entries(rest), lambda e: self.violations(more, e["value"], F.concat(path, F.lit("."), e["key"]), depth)))
            found.append((False, F.when(x.entries.isNotNull(), others).otherwise(_NONE())))
        return found

    def _members_hold(self, schema: dict, x: _Value, depth: int) -> Column:
        found = [self._at(x, name).isNotNull() for name in schema.get("required", [])]
        for name, part in self._named(schema).items():
            holds = self._valid(part, x.members[name], depth) if name in x.members else self.holds(part, self._at(x, name), depth)
            found.append(self._at(x, name).isNull() | holds)
        more, named = schema.get("additionalProperties", True), list(schema.get("properties", {}))
        if more is not True and more != {}:
            other = lambda e: self.holds(more, e["value"], depth)
            found.append(F.forall(F.map_entries(x.entries), lambda e: _in(e["key"], named) | other(e) if named else other(e)))
        return reduce(and_, found) if found else F.lit(True)

    @staticmethod
    def _at(x: _Value, name: str) -> Column:
        return x.members[name].v if name in x.members else F.try_element_at(x.entries, F.lit(name))

    def _one_of(self, x: _Value, values: list) -> Column:
        ok = F.lit(False)
        strings = [v for v in values if isinstance(v, str)]
        numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        flags = [v for v in values if isinstance(v, bool)]
        if strings:
            ok = ok | (x.is_("string") & _in(x.get("string"), strings))
        if numbers:
            ok = ok | (x.is_("number") & _in(x.number, numbers))
        if flags:
            ok = ok | (x.is_("boolean") & _in(x.get("boolean"), flags))
        if None in values:
            ok = ok | x.is_("null")
        if any(isinstance(v, (list, dict)) for v in values):
            raise ValueError("enum and const of arrays or objects aren't compiled")
        return F.coalesce(ok, F.lit(False))


def violations(document: Column, schema: dict) -> Column:
    """What a JSON text breaks of a schema: array<string> of "path keyword", empty for a valid one; text that is no JSON, and null, break "$ json"."""
    compiler = Compiler(schema)
    parsed = lambda v: F.when(v.isNull(), F.array(F.lit("$ json"))).otherwise(F.array_compact(compiler.violations(schema, v, F.lit("$"))))
    return _let(F.try_parse_json(document), parsed)
