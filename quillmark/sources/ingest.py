"""Ingest of result and task files: YAML or JSON documents, one per file, into the canonical tables.

Files are read by Spark (any path it can read) and parsed in Arrow batches; a
malformed file gives no row and is counted. Queries never parse files: they
read the Parquet that ``write_tables`` leaves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names
from . import schemas
from .commits import Folder

#: Column of stored tables that names the file a row came from.
TRACE = "from_file"


def parsed(files: DataFrame) -> DataFrame:
    """(file_path, json, name) of files (path, content): each file's document as JSON text; null where it doesn't parse."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml

            loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        except ImportError:
            yaml = loader = None
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    text = bytes(raw).decode()
                    out.append(json.dumps(json.loads(text) if text.lstrip()[:1] in "{[" else yaml.load(text, loader), default=str))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"file_path": pdf["path"], "json": out})

    return files.select("path", "content").mapInPandas(parse, "file_path string, json string").withColumn("name", F.substring_index("file_path", "/", -1))


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_path, json, name) of the files below a path."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def corrupt(docs: DataFrame) -> DataFrame:
    """Files that didn't parse."""
    return docs.where("json is null").select("file_path")


def _at(path: str, kind: str = "string"):
    return F.get_json_object("json", f"$.{path}").try_cast(kind)


def standard_generations(docs: DataFrame) -> DataFrame:
    """Single-turn result files, with defaults; rows without a task or model are dropped."""
    return _finish(
        docs,
        schemas.GENERATIONS,
        {
            "task_type": F.coalesce(_at("task_type"), F.lit("unknown")),
            "theory": F.coalesce(_at("theory"), F.lit("Unknown")),
            "sample": F.coalesce(_at("sample_index", "int"), F.lit(0)),
            "output": F.coalesce(_at("output"), F.lit("")),
            **{c: F.coalesce(_at(f"metadata.{c}", "bigint"), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens")},
            "generation_cost": F.coalesce(_at("metadata.cost", "double"), F.lit(0.0)),
            "timestamp": F.coalesce(_at("metadata.timestamp"), F.lit("")),
            "success": F.coalesce(_at("metadata.success", "boolean"), F.lit(True)),
            "error": _at("metadata.error"),
        },
    )


def agentic_generations(docs: DataFrame) -> DataFrame:
    """Multi-turn result files."""
    metrics = F.from_json(F.get_json_object("json", "$.metrics"), "total_turns int, questions_asked int, constraints_discovered int, plan_quality double, revision_count int")
    return _finish(
        docs,
        schemas.GENERATIONS,
        {
            "task_type": F.coalesce(_at("task_type"), F.lit("unknown")),
            "theory": F.coalesce(_at("theory"), F.lit("Unknown")),
            "sample": F.coalesce(_at("sample_index", "int"), F.lit(0)),
            "output": F.coalesce(_at("output"), F.lit("")),
            **{c: F.coalesce(_at(f"token_usage.total_{c}", "bigint"), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens")},
            "generation_cost": F.coalesce(_at("token_usage.total_cost", "double"), F.lit(0.0)),
            "timestamp": F.coalesce(_at("timestamp"), F.lit("")),
            "success": F.coalesce(_at("success", "boolean"), F.lit(True)),
            "error": _at("error"),
            "agentic_type": _at("agentic_type"),
            "metrics": metrics,
        },
    )


def numbers_of(text: Column) -> Column:
    """The numbers of a JSON object as map<string,double>; booleans count 1 and 0, entries of any other kind are left out. Null for what is no object."""
    entries = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    number = lambda _, v: F.transform(F.array(F.to_json(v)), lambda text: F.when(text == "true", 1.0).when(text == "false", 0.0).when(F.substring(text, 1, 1).isin("-", *"0123456789"), text.try_cast("double")))[0]
    return F.map_filter(F.transform_values(entries, number), lambda _, x: x.isNotNull())


def evaluations(docs: DataFrame, derive_type: bool = True) -> DataFrame:
    """Judge result files of both kinds; multi-turn ones are those with process scores.

    An absent task type comes from the task id; with ``derive_type`` false, as for single-turn files, it is "unknown".
    """
    tops = ("task_id", "model", "task_type", "sample", "evaluator_model", "evaluator_cost", "timestamp", "success", "final_score", "score_breakdown", "process_scores", "output_scores", "llm_results", "error", "agentic_type", "generation_id")
    docs = docs.select("*", F.json_tuple("json", *tops).alias(*[f"top_{t}" for t in tops]))  # a document is parsed once for all of them
    top = lambda name, kind="string": F.col(f"top_{name}").try_cast(kind)
    process, output = (numbers_of(top(k)) for k in ("process_scores", "output_scores"))
    component = lambda path: F.get_json_object(top("score_breakdown"), f"$.components.{path}").try_cast("double")
    return _finish(
        docs,
        schemas.EVALUATIONS,
        {
            "task_type": F.coalesce(top("task_type"), names.task_type_of(top("task_id")) if derive_type else F.lit("unknown")),
            "sample": F.coalesce(top("sample", "int"), F.lit(0)),
            "evaluator_model": F.coalesce(top("evaluator_model"), F.lit("unknown")),
            "evaluation_cost": F.coalesce(top("evaluator_cost", "double"), F.lit(0.0)),
            "timestamp": F.coalesce(top("timestamp"), F.lit("")),
            "success": F.coalesce(top("success", "boolean"), F.lit(True)),
            "final_score": top("final_score", "double"),
            "word_count_score": component("programmatic.breakdown.word_count_score"),
            "programmatic": component("programmatic.score"),
            "llm_judge": component("llm_judge.score"),
            "process_scores": process,
            "output_scores": output,
            "llm_results": F.from_json(top("llm_results"), "map<string,string>"),
            "error": top("error"),
            "agentic_type": top("agentic_type"),
        },
    )


def tasks(docs: DataFrame) -> DataFrame:
    """Task files; the word range stands in a different place for each type."""
    places = ["requirements.word_count", "continuation_constraints.word_count", "target_requirements.word_count", "word_count"]
    ends = [F.coalesce(*[_at(f"{p}[{k}]", "int") for p in places]) for k in range(2)]
    return _finish(
        docs,
        schemas.TASKS,
        {"task_type": _at("task_type"), "agentic_type": _at("agentic_type"), "theory": _at("theory"), "difficulty": _at("difficulty"), "word_count_min": ends[0], "word_count_max": ends[1], "payload": F.col("json"), "file_path": F.col("file_path")},
        need=("task_id",),
    )


def in_scan_order(tasks: DataFrame) -> DataFrame:
    """Tasks with ``ord``: by type in the fixed order, then by file name."""
    kind = F.array_position(F.array(*map(F.lit, K.TASK_TYPES)), F.col("task_type"))
    return tasks.withColumn("ord", F.struct(kind.alias("type"), F.substring_index("file_path", "/", -1).alias("file")))


def _finish(docs: DataFrame, schema: str, columns: dict, need: tuple[str, ...] = ("task_id", "model")) -> DataFrame:
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    keyed = {k: F.col(f"top_{k}") if f"top_{k}" in docs.columns else _at(k) for k in need} | columns
    traced = [F.col("file_path").alias(TRACE)] if "file_path" in docs.columns else []
    rows = docs.where("json is not null").select(*[(keyed[f.name] if f.name in keyed else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], *traced)
    return rows.dropna(subset=list(need))


def turns(docs: DataFrame) -> DataFrame:
    """Conversation turns of multi-turn result files, in order."""
    item = "array<struct<role:string,content:string,turn_type:string,metadata:map<string,string>>>"
    read = docs.where("json is not null").select(F.coalesce(_at("generation_id"), F.col("name")).alias("generation_id"), F.posexplode(F.from_json(F.get_json_object("json", "$.turns"), item)).alias("turn_idx", "t"), "file_path")
    return read.select("generation_id", "turn_idx", "t.role", "t.turn_type", "t.content", "t.metadata", F.col("file_path").alias(TRACE))


class Conflict(RuntimeError):
    """Another writer has made a version in between."""


#: Versions of stored tables that are kept for readers that are still on them.
KEEP = 3


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in folder.names("log") if n.endswith(".json") and n[0] != ".")


def live_version(spark: SparkSession, out: str) -> int:
    """The number of the tables that readers see; -1 before the first write."""
    return max(_versions(Folder(spark, out)), default=-1)


def write_tables(out: str, based_on: int | None = None, **tables: DataFrame) -> int:
    """Full refresh of canonical tables below ``out``; returns their version.

    The tables are written aside, and a version is one small file that names their folder and is only made if there is none, so a
    reader sees the tables of before or all the new ones, a refresh that dies changes nothing, and of two writers both
    get a version. With ``based_on`` the version must follow that one; else there is a ``Conflict``, and nothing changes.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, name = Folder(spark, out), f"tables-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{out}/{name}/{table}")
    version = live_version(spark, out) + 1 if based_on is None else based_on + 1
    while not folder.create(f"log/{version:020d}.json", json.dumps({"folder": name})):
        if based_on is not None:
            folder.remove(name)
            raise Conflict(f"version {version} is another writer's")
        version += 1
    for old in [v for v in _versions(folder) if v <= version - KEEP]:
        folder.remove(json.loads(folder.read(f"log/{old:020d}.json"))["folder"])
        folder.remove(f"log/{old:020d}.json")
    return version


def stored(spark: SparkSession, out: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """The live table of a name, or that of one of the last versions; empty before the first write."""
    folder = Folder(spark, out)
    at = live_version(spark, out) if version is None else version
    return spark.createDataFrame([], schema) if at < 0 else load_or_empty(spark, f"{out}/{json.loads(folder.read(f'log/{at:020d}.json'))['folder']}/{name}", schema)


#: Kinds of result file: the folder and the names they have below the results.
KINDS = {"generations": ("generations", "*.yaml"), "evaluations": ("evaluations", "*.yaml"), "agentic_generations": ("agentic", "gen_*.yaml"), "agentic_evaluations": ("agentic", "eval_*.yaml")}
MANIFEST = "kind string, path string, length long, modified timestamp, digest string"
#: Changed files of one kind that are read by name; more of them are read with all others.
NAMED = 10_000
#: Starts of a refresh that meets other writers.
STARTS = 20


def _files(spark: SparkSession, results: str, kind: str) -> DataFrame:
    """(path, length, modificationTime, content) of the files of a kind; an absent folder has none."""
    from pyspark.errors import AnalysisException

    folder, pattern = KINDS[kind]
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(f"{results}/{folder}")
    except AnalysisException:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def _tables(docs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ledger's tables out of the documents of each kind."""
    return {
        "generations": standard_generations(docs["generations"]).unionByName(agentic_generations(docs["agentic_generations"])),
        "evaluations": evaluations(docs["evaluations"], derive_type=False).unionByName(evaluations(docs["agentic_evaluations"])),
        "turns": turns(docs["agentic_generations"]),
        "unreadable": reduce(DataFrame.unionByName, map(corrupt, docs.values())).withColumn(TRACE, F.col("file_path")),
    }


_STORED = {"generations": schemas.GENERATIONS, "evaluations": schemas.EVALUATIONS, "turns": schemas.TURNS, "unreadable": "file_path string"}


def _rebuilt(spark: SparkSession, out: str, version: int, read: int) -> DataFrame:
    count = lambda name: stored(spark, out, name, _STORED[name]).agg(F.count(F.lit(1)).alias(name))
    counts = count("generations").crossJoin(count("evaluations")).crossJoin(count("unreadable"))
    return counts.withColumn("version", F.lit(version)).withColumn("parsed", F.lit(read))


def rebuild(spark: SparkSession, results: str, out: str) -> DataFrame:
    """Rebuild the ledger from all result files and swap it in.

    Below ``results``: generations/ and evaluations/ with single-turn files, agentic/ with multi-turn gen_* and eval_* files; a
    folder may be absent. Returns one row: (generations, evaluations, unreadable, version, parsed), where unreadable counts the files
    that don't parse; the files themselves are in the stored table ``unreadable``. The stored table ``manifest`` tells what was read.
    """
    files = {kind: _files(spark, results, kind) for kind in KINDS}
    seen = [f.select(F.lit(kind).alias("kind"), "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest")) for kind, f in files.items()]
    version = write_tables(out, manifest=reduce(DataFrame.unionByName, seen), **_tables({kind: parsed(f) for kind, f in files.items()}))
    return _rebuilt(spark, out, version, stored(spark, out, "manifest", MANIFEST).count())


def refresh(spark: SparkSession, results: str, out: str) -> DataFrame:
    """As ``rebuild``, and with the same tables, but only files that are new or whose bytes have changed are parsed.

    Files of the same length and time as in the manifest aren't opened; others are, and parsed if their digest differs. The rows of
    changed and deleted files are taken back by the file that each row came from. ``parsed`` counts the files that were parsed; where nothing changed,
    no version is made. Which files changed is known to the driver, as Spark's own list of files is.
    """
    for _ in range(STARTS):
        try:
            return _refreshed(spark, results, out)
        except Conflict:  # start again from what the other writer left
            continue
    raise Conflict(f"other writers were first {STARTS} times")


def _refreshed(spark: SparkSession, results: str, out: str) -> DataFrame:
    version = live_version(spark, out)
    if version < 0:
        return rebuild(spark, results, out)
    old = stored(spark, out, "manifest", MANIFEST, version)
    known = old.select("kind", "path", F.col("length").alias("was_length"), F.col("modified").alias("was_modified"), F.col("digest").alias("was_digest"))
    opened: dict[str, DataFrame] = {}
    listed = []
    for kind in KINDS:
        files = _files(spark, results, kind)
        now = files.select(F.lit(kind).alias("kind"), "path", "length", F.col("modificationTime").alias("modified")).join(known, ["kind", "path"], "left")
        touched = now.where(~F.coalesce((F.col("length") == F.col("was_length")) & (F.col("modified") == F.col("was_modified")), F.lit(False))).select("path")
        names = [r.path for r in touched.limit(NAMED + 1).collect()]
        if not names:
            opened[kind] = files.limit(0)
        elif len(names) <= NAMED:
            opened[kind] = spark.read.format("binaryFile").load([n.replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for n in names])
        else:
            opened[kind] = files.join(touched, "path", "left_semi")
        digests = opened[kind].select("path", F.sha2("content", 256).alias("digest"))
        listed.append(now.join(digests, "path", "left").select("kind", "path", "length", "modified", F.coalesce("digest", "was_digest").alias("digest"), "was_digest"))
    path = f"{out}/listed/{uuid.uuid4().hex}"  # what a file is now is looked at once
    reduce(DataFrame.unionByName, listed).write.parquet(path)
    listing = spark.read.schema(f"{MANIFEST}, was_digest string").parquet(path)
    changed = listing.where(~F.col("digest").eqNullSafe(F.col("was_digest")))
    gone = old.join(listing.select("kind", "path"), ["kind", "path"], "left_anti").select("kind", "path")
    stale = gone.unionByName(changed.where("was_digest is not null").select("kind", "path"))
    read, retracted = changed.count(), stale.limit(1).count()
    if read or retracted:
        fresh = _tables({kind: parsed(opened[kind].join(changed.where(F.col("kind") == kind).select("path"), "path", "left_semi")) for kind in KINDS})
        kept = {n: stored(spark, out, n, f"{schema}, {TRACE} string", version).join(stale.select(F.col("path").alias(TRACE)), TRACE, "left_anti") for n, schema in _STORED.items()}
        version = write_tables(out, version, manifest=listing.drop("was_digest"), **{n: kept[n].unionByName(fresh[n]) for n in _STORED})
    Folder(spark, out).remove(path.removeprefix(f"{out}/"))
    return _rebuilt(spark, out, version, read)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
