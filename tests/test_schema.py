"""The schema compiler against a plain validator, and many patterns against a plain search."""

import glob
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark.functions import patterns, schema
from quillmark.plans.catalog import ORDER_SCHEMA


def kind_of(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "integer" if float(x).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def plain(s, x, root, path="$"):
    """A direct validator: the "path keyword" of everything that is broken."""
    if s is True or s == {}:
        return []
    if s is False:
        return [f"{path} false"]
    kind, out = kind_of(x), []
    bad = lambda keyword, wrong: out.append(f"{path} {keyword}") if wrong else None
    ok = lambda part: not plain(part, x, root)
    if "$ref" in s:
        at = root
        for part in s["$ref"].strip("#/").split("/"):
            at = at[part]
        out += plain(at, x, root, path)
    if "type" in s:
        named = [s["type"]] if isinstance(s["type"], str) else s["type"]
        bad("type", not (kind in named or kind == "integer" and "number" in named))
    same = lambda a, b: kind_of(a) == kind_of(b) and a == b
    bad("enum", "enum" in s and not any(same(x, v) for v in s["enum"]))
    bad("const", "const" in s and not same(x, s["const"]))
    number = kind in ("integer", "number")
    if kind == "string":
        bad("pattern", "pattern" in s and not re.search(s["pattern"], x))
        bad("minLength", len(x) < s.get("minLength", 0))
        bad("maxLength", len(x) > s.get("maxLength", 10**9))
    if number:
        bad("minimum", x < s.get("minimum", x))
        bad("maximum", x > s.get("maximum", x))
        bad("exclusiveMinimum", "exclusiveMinimum" in s and x <= s["exclusiveMinimum"])
        bad("exclusiveMaximum", "exclusiveMaximum" in s and x >= s["exclusiveMaximum"])
        bad("multipleOf", "multipleOf" in s and x % s["multipleOf"] != 0)
    if kind == "array":
        bad("minItems", len(x) < s.get("minItems", 0))
        bad("maxItems", len(x) > s.get("maxItems", 10**9))
        bad("uniqueItems", bool(s.get("uniqueItems")) and len({json.dumps(i, sort_keys=True) for i in x}) < len(x))
        for i, item in enumerate(x):
            out += plain(s.get("items", True), item, root, f"{path}[{i}]")
    if kind == "object":
        bad("minProperties", len(x) < s.get("minProperties", 0))
        bad("maxProperties", len(x) > s.get("maxProperties", 10**9))
        out += [f"{path}.{k} required" for k in s.get("required", []) if k not in x]
        for k, v in x.items():
            part = s.get("properties", {}).get(k, s.get("additionalProperties", True))
            out += plain(part, v, root, f"{path}.{k}")
    for part in s.get("allOf", []):
        out += plain(part, x, root, path)
    bad("anyOf", "anyOf" in s and not any(map(ok, s["anyOf"])))
    bad("oneOf", "oneOf" in s and sum(map(ok, s["oneOf"])) != 1)
    bad("not", "not" in s and ok(s["not"]))
    if "if" in s:
        out += plain(s.get("then" if ok(s["if"]) else "else", True), x, root, path)
    return out


SCHEMAS = [
    ORDER_SCHEMA,
    {"type": ["object", "null"], "minProperties": 1, "maxProperties": 3, "additionalProperties": {"type": "integer", "multipleOf": 2}, "properties": {"a": {"anyOf": [{"type": "string", "minLength": 2}, {"type": "array", "uniqueItems": True, "maxItems": 3}]}, "b": True, "c": False}},
    {"oneOf": [{"type": "integer"}, {"type": "number", "exclusiveMinimum": 1}, {"type": "string", "maxLength": 3, "pattern": "x"}], "not": {"const": 7}},
    {"type": "array", "items": {"type": "array", "items": {"enum": [1, "a", None, True, 2.5]}, "minItems": 1}, "maxItems": 4},
    {"type": "object", "properties": {"n": {"const": None}, "f": {"const": False}, "deep": {"properties": {"er": {"type": "number", "minimum": -1, "maximum": 1}}, "required": ["er"]}}, "if": {"required": ["n"]}, "then": {"required": ["f"]}},
]


def some_value(rng, depth=0):
    pick = rng.randrange(9 if depth < 3 else 6)
    if pick == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if pick > 6:
        keys = ["a", "b", "c", "n", "f", "deep", "er", "key", "status", "lines", "closed", "mode", "quantity", "discount"]
        return {k: some_value(rng, depth + 1) for k in rng.sample(keys, rng.randrange(6))}
    return [None, rng.random() < 0.5, rng.randrange(-3, 9), round(rng.uniform(-2, 60), 1), rng.choice(["", "x", "ax", "xyz", "abcd", "F", "A", "a"]), 2.0][pick]


@pytest.mark.parametrize("n", range(len(SCHEMAS)))
def test_compiled_schema_equals_plain_validator(spark, n):
    rng = random.Random(n)
    s = SCHEMAS[n]
    values = [some_value(rng) for _ in range(250)]
    if n == 0:
        line = lambda: {k: v for k, v in (("mode", rng.choice(["A", "R"])), ("quantity", rng.choice([1, 45, 46, "3"])), ("discount", rng.choice([0.05, 0.09])), ("more", 1)) if rng.random() < 0.85}
        values += [{"key": rng.choice([1, 1.5]), "status": rng.choice("FOX"), "lines": [line() for _ in range(rng.randrange(4))], **({"closed": 1} if rng.random() < 0.5 else {})} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, doc string")
    got = {r.i: sorted(r.v) for r in df.select("i", schema.violations(F.col("doc"), s).alias("v")).collect()}
    want = {i: sorted(plain(s, v, s)) for i, v in enumerate(values)}
    assert got == want and 20 < sum(map(bool, want.values()))


def test_schema_edges(spark):
    docs = spark.createDataFrame([(0, "{broken"), (1, None), (2, "null"), (3, "{}")], "i int, doc string")
    got = {r.i: r.v for r in docs.select("i", schema.violations(F.col("doc"), {"type": "object", "required": ["x"]}).alias("v")).collect()}
    assert got == {0: ["$ json"], 1: ["$ json"], 2: ["$ type"], 3: ["$.x required"]}
    for wrong in ({"dependencies": {}}, {"$ref": "other.json"}, {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}):
        with pytest.raises(ValueError):
            schema.violations(F.col("doc"), wrong)


#: Several schemas that look at one value and its members, members of members, long and mixed enums, and references from members.
SHARED = [
    {"definitions": {"few": {"enum": [1, 1.0, "a", None]}, "deep": {"properties": {"er": {"$ref": "#/definitions/few"}, "a": {"items": {"type": "integer"}}}}},
     "properties": {"a": {"$ref": "#/definitions/few"}, "deep": {"$ref": "#/definitions/deep"}, "n": {"type": "number"}},
     "allOf": [{"properties": {"a": {"type": ["integer", "null"]}, "n": {"maximum": 5}, "c": {"minLength": 1}}, "required": ["n"]}, {"minProperties": 2}],
     "if": {"properties": {"n": {"minimum": 0}, "deep": {"required": ["er"]}}}, "then": {"properties": {"b": {"const": True}, "f": {"minItems": 1}}, "maxProperties": 4}, "else": False},
    {"additionalProperties": {"anyOf": [{"type": ["object", "string", "array"]}, {"enum": list(range(12))}]}, "properties": {"er": {"description": "anything"}, "a": {"not": {"type": ["string", "array", "object"]}}, "deep": {"additionalProperties": False}}},
    {"type": ["object", "array", "string"], "items": {"oneOf": [{"properties": {"a": {"type": "string"}}, "type": "object"}, {"enum": ["", "x", "ax", "xyz", "abcd", "F", "A", "a", "b", "c", "d"]}, {"minimum": 2}]}, "minLength": 2, "not": {"required": ["a"], "additionalProperties": {"type": "integer"}, "type": "object"}},
]


@pytest.mark.parametrize("n", range(len(SHARED)))
def test_schemas_that_share_a_value_equal_plain_validator(spark, n):
    rng = random.Random(50 + n)
    values = [some_value(rng) for _ in range(400)] + [{k: some_value(rng, 1) for k in rng.sample(["a", "b", "c", "n", "f", "deep", "er"], rng.randrange(7))} for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, doc string").repartition(4)
    got = {r.i: sorted(r.v) for r in df.select("i", schema.violations(F.col("doc"), SHARED[n]).alias("v")).collect()}
    want = {i: sorted(plain(SHARED[n], v, SHARED[n])) for i, v in enumerate(values)}
    assert got == want and 20 < sum(map(bool, want.values())) < 600


def test_parts_of_a_value_are_found_once_for_all_its_schemas(spark):
    """Orders and their lines are the only objects that are asked for members, whatever number of schemas look at them; nothing in a lambda ends by an exception."""
    df = spark.createDataFrame([("{}",)], "doc string").select(schema.violations(F.col("doc"), ORDER_SCHEMA))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapType(") == 2 and plan.count("SchemaOfVariant.schemaOfVariant(") < 12
    assert "array_contains(" not in plan and " IN (" not in plan


@pytest.mark.skipif(not os.environ.get("QUILLMARK_SCHEMAS"), reason="QUILLMARK_SCHEMAS names no folder of schemas and documents")
def test_published_schemas(spark):
    """Published schemas as they are (*schema*.json), over the documents beside them, whole and with parts taken out."""
    import yaml

    folder = os.environ["QUILLMARK_SCHEMAS"]
    docs = [yaml.safe_load(open(p)) for p in sorted(glob.glob(f"{folder}/**/*.yaml", recursive=True))]
    rng = random.Random(1)
    for d in [d for d in docs if isinstance(d, dict)]:
        less = {k: v for k, v in d.items() if rng.random() < 0.8}
        docs += [less, {k: (v[:1] if isinstance(v, list) else 7 if rng.random() < 0.2 else v) for k, v in d.items()}]
    df = spark.createDataFrame([(i, json.dumps(d, default=str)) for i, d in enumerate(docs)], "i int, doc string")
    for p in glob.glob(f"{folder}/**/*schema*.json", recursive=True):
        s = json.load(open(p))
        got = {r.i: sorted(r.v) for r in df.select("i", schema.violations(F.col("doc"), s).alias("v")).collect()}
        assert got == {i: sorted(plain(s, json.loads(json.dumps(d, default=str)), s)) for i, d in enumerate(docs)}


def test_many_phrases_equal_plain_search(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    phrases = sorted({word(rng.randrange(1, 7)) for _ in range(200)} | {"aa", "aaa", "é", "ß x"})
    texts = [word(rng.randrange(200)).upper() for _ in range(60)] + ["aaaaaaa", "É ß X", "", None]
    want = [{p: n for p in phrases if (n := (t or "").lower().count(p))} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: (r.m, r.w) for r in df.select("i", patterns.phrase_counts(F.col("t"), phrases).alias("m"), patterns.phrase_weight(F.col("t"), {p: 0.5 for p in phrases}).alias("w")).collect()}
    assert [got[i][0] for i in range(len(texts))] == want and [got[i][1] for i in range(len(texts))] == [0.5 * sum(w.values()) for w in want]
    slow = patterns.Automaton(phrases)
    slow.walk = None
    assert all(slow.counts(t.lower()) == patterns.Automaton(phrases).counts(t.lower()) for t in texts if t)
    with pytest.raises(ValueError):
        patterns.phrase_counts(F.col("t"), ["a", ""])


def test_first_rule_wins(spark):
    rules = [("YES", ["Dragon", "wyrm"]), ("MAYBE", ["rag", "color"]), ("NEVER", ["dragon"])]
    df = spark.createDataFrame([(0, "Is there a DRAGON?"), (1, "rags?"), (2, "what?"), (3, None)], "i int, q string")
    assert [r.a for r in df.orderBy("i").select(patterns.first_rule(F.col("q"), rules).alias("a")).collect()] == ["YES", "MAYBE", "NO", "NO"]


def test_ten_thousand_patterns_cost_no_more_than_ten(spark):
    import time

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60_000))
    took = []
    for n in (10, 10_000):
        walk = patterns.Automaton(["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n)])
        begin = time.perf_counter()
        for _ in range(3):
            walk.counts(text)
        took.append(time.perf_counter() - begin)
    assert took[1] < 20 * took[0] + 0.2  # a thousand times as many
