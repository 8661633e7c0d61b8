"""The growing ledger: splits, filters, concurrent writers, change feeds; and conversations that call once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import conversations, generate, turns
from quillmark.sources import commits
from quillmark.sources.commits import CommitLog, Folder
from quillmark.streaming import ledger_stream

SCHEMA = "k string, v int, body string"



def put(spark, out, rows, batch, source="s", **kw):
    return ledger_stream.upsert_batch(spark.createDataFrame(rows, SCHEMA), batch, out, ("k",), [F.desc("v")], source, **kw)


def table(spark, out, version=None):
    return {r.k: (r.v, r.body) for r in ledger_stream.current(spark, out, SCHEMA, version).collect()}


def test_leaves_split_and_stay_below_the_limit(spark, tmp_path):
    out, rng, want = str(tmp_path / "t"), random.Random(1), {}
    body = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(50, 250)))
    for b, n in enumerate((40, 1500, 300)):
        rows = [(f"k{rng.randint(0, 1200)}", b * 10_000 + i, body()) for i in range(n)]
        put(spark, out, rows, b, limit=30_000, most=3)
        want |= {k: (v, t) for k, v, t in rows}
        state = CommitLog(spark, out).snapshot()
        assert table(spark, out) == want
        assert sum(f["rows"] for f in state.files.values()) == len(want) and all(f["bytes"] <= 30_000 for f in state.files.values())
        assert sum(2.0 ** (1 - len(x)) for x in state.leaves) == 1 and {f["leaf"] for f in state.files.values()} <= state.leaves
    assert len(state.leaves) >= 8
    some = sorted(want)[7]
    record = put(spark, out, [(some, 10**6, "new")], 9, limit=30_000, most=3)
    assert len(record["touched"]) == 1 and len(record["remove"]) <= 3 and table(spark, out) == want | {some: (10**6, "new")}
    fresh = put(spark, out, [("unseen", 1, "x")], 10, limit=30_000, most=50)
    assert not fresh["remove"] or len(fresh["remove"]) == 1  # a filter may err, a key that isn't there costs no rewriting otherwise


def test_new_keys_leave_old_files_alone(spark, tmp_path):
    out = str(tmp_path / "t")
    put(spark, out, [(f"a{i}", 1, "x") for i in range(50)], 0)
    record = put(spark, out, [(f"b{i}", 1, "x") for i in range(5)], 1)
    assert not record["remove"] and len(CommitLog(spark, out).snapshot().files) == 2
    for b in range(2, 6):
        put(spark, out, [(f"c{b}", 1, "x")], b, most=3)
    assert len(CommitLog(spark, out).snapshot().files) <= 4 and len(table(spark, out)) == 59


def test_odd_keys_and_repeats(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = [(None, 1, "a"), (None, 2, "b"), ("", 1, "c"), ("\0", 1, "d"), ("x", 3, None), ("x", 2, "e")] + [("hot", i, "h") for i in range(500)]
    put(spark, out, rows, 0)
    put(spark, out, [(None, 0, "later"), ("x", 0, "f")], 1)
    assert table(spark, out) == {None: (0, "later"), "": (1, "c"), "\0": (1, "d"), "x": (0, "f"), "hot": (499, "h")}
    put(spark, out, [], 2)
    assert len(table(spark, out)) == 5 and ledger_stream.current_version(spark, out) == 2


def test_two_interleaved_writers_lose_no_row(spark, tmp_path, monkeypatch):
    """The second writer commits while the first one is at work: both are in, in either case."""
    out = str(tmp_path / "t")
    put(spark, out, [(f"k{i}", 0, "old") for i in range(40)], 0)
    plain, inside = ledger_stream._prepare, []

    def interrupted(*args):
        record = plain(*args)
        if not inside:
            inside.append(1)
            put(spark, out, [("k1", 5, "other"), ("theirs", 5, "other")], 0, "other")
        return record

    monkeypatch.setattr(ledger_stream, "_prepare", interrupted)
    put(spark, out, [("k1", 7, "mine"), ("k2", 7, "mine"), ("mine", 7, "mine")], 1)
    got = table(spark, out)
    assert len(got) == 42 and got["theirs"] == (5, "other") and got["mine"] == got["k1"] == got["k2"] == (7, "mine")
    assert ledger_stream.current_version(spark, out) == 2


def test_writers_of_other_leaves_don_t_wait(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    put(spark, out, [(f"k{i}", 0, "x" * 200) for i in range(400)], 0, limit=6000)
    state = CommitLog(spark, out).snapshot()
    leaf = {r["k"]: r["__leaf"] for r in ledger_stream._in_leaf(spark.createDataFrame([(f"k{i}",) for i in range(400)], "k string").withColumn("__hash", F.xxhash64("k")), state.leaves).collect()}
    a, b = "k0", next(k for k in leaf if leaf[k] != leaf["k0"])
    plain, calls = ledger_stream._prepare, []

    def interrupted(*args):
        record = plain(*args)
        calls.append(1)
        if len(calls) == 1:
            put(spark, out, [(b, 9, "other")], 0, "other", limit=6000)
        return record

    monkeypatch.setattr(ledger_stream, "_prepare", interrupted)
    put(spark, out, [(a, 9, "mine")], 1, limit=6000)
    got = table(spark, out)
    assert len(calls) == 2 and got[a] == (9, "mine") and got[b] == (9, "other") and len(got) == 400


@pytest.mark.parametrize("links", [True, False])
def test_a_version_is_made_once(spark, tmp_path, links):
    folder = Folder(spark, str(tmp_path))
    folder.links = links
    assert folder.create("log/1.json", "first") and not folder.create("log/1.json", "second")
    assert folder.read("log/1.json") == "first" and folder.names("log") in (["1.json"], [".1.json.crc", "1.json"])


def test_snapshots_versions_and_changes(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    for b in range(9):
        put(spark, out, [(f"k{b % 3}", b, "x"), ("always", b, "y")], b)
    log = CommitLog(spark, out)
    assert log.latest() == 8 and len(log.folder.names("log")) < 12
    assert table(spark, out, 6)["always"] == (6, "y") and table(spark, out)["always"] == (8, "y")
    put(spark, out, [("k0", 6, "x"), ("new", 1, "z")], 9)  # k0 as it was
    got = {(r.change, (r.after or r.before).k) for r in ledger_stream.changes(spark, out, SCHEMA, ("k",), 7).collect()}
    assert got == {("update", "k2"), ("update", "always"), ("insert", "new")}
    assert ledger_stream.changes(spark, out, SCHEMA, ("k",), 9).count() == 0
    assert len(os.listdir(f"{out}/data")) == len(os.listdir(f"{out}/filters")) <= 8  # what no version needs is deleted


def counting(folder):
    """A client that leaves one file for every call it gets, and dies where it is told to."""

    def make():
        def call(prompt):
            import os
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            if os.path.exists(f"{folder}.dies") and "dies" in prompt:
                os._exit(1)
            if "refused" in prompt:
                raise RuntimeError("refused")
            return f"answer to {len(prompt)}", len(prompt), 2

        return call

    return make


def prompts(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_each_prompt_is_asked_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    work = spark.createDataFrame([("g1", "one"), ("g2", "two"), ("g3", "refused")], "generation_id string, prompt string")
    talk = lambda: generate.conversation(work, counting(asked), 4, lambda answer, r: F.concat(answer, F.lit(f" round {r}")), 1, 0.0, str(tmp_path / "log"))
    first = sorted(map(tuple, talk().collect()))
    assert len(os.listdir(asked)) == 9 and len(first) == 18  # four rounds of two, one refusal
    assert sorted(map(tuple, talk().collect())) == first and len(os.listdir(asked)) == 9  # a second run asks nothing


def test_after_a_crash_only_what_is_missing_is_asked(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    (tmp_path / "asked.dies").write_text("")
    rows = [(f"g{i}", f"prompt {i}" + (" dies" if i == 3 else "")) for i in range(6)]
    requests = spark.createDataFrame(rows, "generation_id string, prompt string")
    once = lambda **kw: generate.call_once(requests, counting(asked), str(tmp_path / "log"), 0, 1, 0.0, 1, **kw)
    with pytest.raises(Exception):
        once()
    before = prompts(asked)
    os.remove(tmp_path / "asked.dies")
    assert {r.generation_id for r in once().where("success").collect()} == {f"g{i}" for i in range(6)}
    again = prompts(asked)
    assert set(again) == {p for _, p in rows}
    logged = [p for p in set(again) if again.count(p) == 1]
    assert len(again) == len(before) + sum(p not in before or "dies" in p or again.count(p) > 1 for _, p in rows)
    assert len(logged) >= 4  # only what was running as the job died may be asked again
    once()
    assert prompts(asked) == again


def test_refused_requests_are_asked_again_on_demand(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    requests = spark.createDataFrame([("a", "refused"), ("b", "fine"), ("b", "fine")], "generation_id string, prompt string")
    for retry, calls in ((False, 2), (False, 2), (True, 3)):
        got = generate.call_once(requests, counting(asked), str(tmp_path / "log"), 0, 1, 0.0, retry_failed=retry).collect()
        assert len(os.listdir(asked)) == calls and {r.generation_id: r.success for r in got} == {"a": False, "b": True}


def scripted(answers):
    """A client that answers by what the last message says."""

    def make():
        def call(prompt):
            import json

            said = json.loads(prompt)
            last = said[-1]["content"]
            for key, answer in answers.items():
                if key in last:
                    return answer.replace("{n}", str(len(said))), len(said), 1
            return "plain text", len(said), 1

        return call

    return make


def test_discovery(spark, tmp_path):
    work = spark.createDataFrame([("g1", "begin", 2), ("g2", "begin", 1)], "generation_id string, prompt string, most int")
    oracle = conversations.callable_oracle(lambda q: "YES" if "dragon" in q else "NO")
    calls = conversations.discovery(2, oracle, F.concat(F.lit("write, found "), F.size(F.filter("turns", lambda t: (t["turn_type"] == "answer") & (t["content"] == "YES"))).cast("string")), F.col("most"))
    opening = F.array(conversations.turn("system", "system", F.lit("be brief")), conversations.turn("user", "context", F.col("prompt")))
    done = conversations.run(work, scripted({"begin": " is there a dragon? ", "YES": "is it red?", "write, found 1": "A dragon story"}), calls, str(tmp_path / "log"), opening, 1, 0.0)
    got = {r.generation_id: r for r in done.collect()}
    assert [t.turn_type for t in got["g1"].turns] == ["system", "context", "question", "answer", "question", "answer", "generation_prompt", "generation"]
    assert [t.content for t in got["g1"].turns[2:6]] == ["is there a dragon?", "YES", "is it red?", "NO"] and got["g1"].output == "A dragon story"
    assert (got["g1"].calls, got["g2"].calls, got["g1"].prompt_tokens, got["g1"].success, got["g2"].most) == (3, 2, 2 + 4 + 7, True, 1)
    metrics = {r.generation_id: r for r in turns.turn_metrics(conversations.turns_of(done)).collect()}
    assert (metrics["g1"].questions_asked, metrics["g1"].constraints_discovered, metrics["g2"].questions_asked) == (2, 1, 1)


def test_discovery_with_a_model_as_oracle(spark, tmp_path):
    work = spark.createDataFrame([("g1", "begin")], "generation_id string, prompt string")
    parse = lambda reply: turns.oracle_answer(reply, F.array(F.lit("NO"), F.lit("YES")))
    calls = conversations.judged_discovery(1, scripted({"dragon": "constraint 2"}), lambda q: F.concat(F.lit("which one fits "), q), parse, F.lit("write"))
    opening = F.array(conversations.turn("user", "context", F.col("prompt")))
    (r,) = conversations.run(work, scripted({"begin": "a dragon?", "write": "text"}), calls, str(tmp_path / "log"), opening, 1, 0.0).collect()
    assert [(t.turn_type, t.content) for t in r.turns] == [("context", "begin"), ("question", "a dragon?"), ("answer", "YES"), ("generation_prompt", "write"), ("generation", "text")]


def test_planning_revision_and_critique(spark, tmp_path):
    opening = F.array(conversations.turn("user", "initial_prompt", F.col("prompt")))
    work = spark.createDataFrame([("g1", "begin", {1: "shorter", 2: "sadder"}), ("g2", "begin", {1: "shorter", 3: "never"}), ("g3", "blank", None)], "generation_id string, prompt string, rules map<int,string>")
    go = lambda name, calls, answers: {r.generation_id: r for r in conversations.run(work, scripted(answers), calls, str(tmp_path / name), opening, 1, 0.0).collect()}
    plan = go("p", conversations.planning(F.lit("now write")), {"begin": "a plan", "now write": "done {n}", "blank": "  "})
    assert [t.turn_type for t in plan["g1"].turns] == ["initial_prompt", "plan", "execution_prompt", "generation"] and plan["g1"].output == "done 3" and plan["g3"].success
    revised = go("r", conversations.revision(3, lambda r: F.try_element_at("rules", F.lit(r))), {"begin": "v0", "shorter": "v1", "sadder": "v2", "blank": "  "})
    assert [revised[g].output for g in ("g1", "g2", "g3")] == ["v2", "v1", "  "] and [revised[g].calls for g in ("g1", "g2", "g3")] == [3, 2, 1]
    assert (revised["g3"].success, revised["g3"].error) == (False, "empty generation")
    critic = scripted({"judge v0": "too long", "judge v1": "too sad"})
    better = go("c", conversations.critique(2, critic, lambda x: F.concat(F.lit("judge "), x), lambda c: F.concat(F.lit("mend: "), c)), {"begin": "v0", "mend: too long": "v1", "mend: too sad": "v2", "blank": "v0"})
    assert better["g1"].output == "v2" and [t.turn_type for t in better["g1"].turns] == ["initial_prompt", "generation"] + ["critique", "revision_prompt", "generation"] * 2


def test_failed_calls_end_a_conversation(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    work = spark.createDataFrame([("g1", "fine"), ("g2", "refused")], "generation_id string, prompt string")
    opening = F.array(conversations.turn("user", "plan_prompt", F.col("prompt")))
    run = lambda: {r.generation_id: r for r in conversations.run(work, counting(asked), conversations.planning(F.lit("go")), str(tmp_path / "log"), opening, 1, 0.0).collect()}
    got = run()
    assert got["g1"].success and not got["g2"].success and "refused" in got["g2"].error and len(os.listdir(asked)) == 3
    assert run() == got and len(os.listdir(asked)) == 3
    with pytest.raises(ValueError):
        conversations.run(work.union(work), counting(asked), [], str(tmp_path / "log"))
    assert conversations.run(work.limit(0), counting(asked), conversations.planning(F.lit("go")), str(tmp_path / "none"), opening).count() == 0
