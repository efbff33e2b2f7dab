"""Reviews in rounds against one review after another, and their limits."""

import json

import pytest

from prospector.operators import reviews, tools

P, C, H, X = ("abcd"[k] * 40 for k in range(4))
CHANGE = "array<struct<status:string,path:string,old_path:string>>"


@pytest.fixture(scope="module")
def repo(spark):
    rows = [(H, 0, [C], "later\n", "t3", [("M", "z", None)], bytearray(b"+z")), (C, 1, [P], "fix it\n\nwhy", "t2", [("R100", "src/x.py", "src/w.py")], bytearray(b"+" * 40_000)), (P, 2, [X], "second", None, [("A", "src/x.py", None)], bytearray(b"+\xffx")), (X, 3, [], "root", "t0", [], None)]
    commits = spark.createDataFrame(rows, f"sha string, place long, parents array<string>, message string, committer_time string, changed_paths {CHANGE}, patch binary")
    files = spark.createDataFrame([(C, "src/x.py", 'one\n  two   2\n\nf"ö"ur\n'), (C, "big", "y" * 40_000), (C, "wide", "two " * 7_000), (P, "src/x.py", "one"), (H, "src/x.py", "head")] + [(C, f"many/{k:03d}", "n") for k in range(60)], "sha string, path string, content string")
    blame = spark.createDataFrame([(C, "src/x.py", k, P) for k in (1, 2, 3)], "sha string, path string, line int, commit string")
    return commits, files, blame


CALLS = [
    ("show_commit", {}), ("show_commit", {"revision": "parent"}), ("show_commit", {"revision": "ddddddd"}), ("show_commit", {"revision": "main"}), ("show_diff", {"parent": "parent"}), ("show_diff", {"revision": "parent"}), ("show_diff", {"parent": "head"}),
    ("read_blob", {"path": "src/x.py"}), ("read_blob", {"path": "big"}), ("read_blob", {"path": "none"}), ("read_blob", {"path": "a/../b"}), ("read_range", {"path": "src/x.py", "start_line": 2, "end_line": 99}), ("read_range", {"path": "src/x.py", "start_line": 90, "end_line": 99}),
    ("read_range", {"path": "x", "start_line": 0, "end_line": 1}), ("cite", {"path": "src/x.py", "start_line": 2, "end_line": 3, "supports": ["impact"]}), ("cite", {"revision": "head", "path": "src/x.py", "start_line": 1, "end_line": 1, "supports": ["severity", "impact"]}),
    ("cite", {"path": "src/x.py", "start_line": 3, "end_line": 3, "supports": ["impact"]}), ("cite", {"path": "src/x.py", "start_line": 1, "end_line": 1, "supports": ["magic"]}), ("search", {"query": "two", "path": "src/x.py"}), ("search", {"query": "n", "limit": 50}), ("search", {"query": "absent"}),
    ("list_paths", {"prefix": "many", "limit": 7}), ("list_paths", {}), ("list_paths", {"prefix": "no"}), ("history", {}), ("history", {"revision": "head", "path": "z"}), ("history", {"path": "src/x.py", "limit": 1}), ("history", {"revision": "parent", "path": "src/w.py"}), ("blame", {"path": "src/x.py", "start_line": 2, "end_line": 9}),
    ("blame", {"path": "none", "start_line": 1, "end_line": 1}), ("rm", {}), ("show_commit", {"x": 1}), ("linked_artifact", {"kind": "pr"}),
]


def script(messages, tools_on):
    """What each conversation does is in its first message: per turn so many of CALLS from so far on, then an answer."""
    plan = json.loads(messages[0]["content"])
    turns = sum(m["role"] == "assistant" for m in messages)
    if plan.get("fail") == turns:
        raise OSError("down")
    if turns >= plan["turns"] or (not tools_on and not plan.get("stubborn")):
        return json.dumps({"verdict": "YES", "seen": sum(m["role"] == "tool" for m in messages)})
    at = [CALLS[(plan["from"] + turns * plan["each"] + k) % len(CALLS)] for k in range(plan["each"])]
    if "only" in plan:
        at = [CALLS[plan["only"]]] * plan["each"]
    return {"content": None, "tool_calls": [{"id": f"t{turns}-{k}", "name": n, "arguments": a} for k, (n, a) in enumerate(at)]}


def one_by_one(repo, sha, plan, limits):
    """The same review call by call."""
    kit = tools.Tools(*repo, sha)
    messages, turns, calls, used, forced = [{"role": "user", "content": json.dumps(plan)}], 0, 0, 0, False
    while turns < limits.turns:
        turns += 1
        try:
            said = script(messages, not forced)
        except OSError:
            return "stopped", "model_error:OSError", None, turns, calls, used
        if isinstance(said, str):
            return "answered", None, said, turns, calls, used
        if forced:
            return "stopped", "calls", None, turns, calls, used
        messages.append({"role": "assistant"})
        for call in said["tool_calls"]:
            if calls >= limits.calls:
                forced = True
                messages += [{"role": "tool"}, {"role": "user"}]
                break
            calls += 1
            try:
                value = kit.execute(call["name"], call["arguments"])
                text = json.dumps({"ok": True, "result": value}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError as why:
                text = json.dumps({"error": f"ValueError: {why}", "ok": False}, separators=(",", ":"), ensure_ascii=False)
            left = limits.bytes - used
            if left <= 0:
                return "stopped", "bytes", None, turns, calls + len(said["tool_calls"]) - said["tool_calls"].index(call) - 1, used
            used += len(text.encode()[: min(limits.result_bytes, left)].decode("utf-8", "ignore").encode())
            messages.append({"role": "tool", "content": text})
    return "stopped", "turns", None, turns, calls, used


def test_every_answer_is_that_of_the_tools(spark, repo):
    names = spark.createDataFrame([(C, C, P, H)], "sha string, commit string, parent string, head string")
    calls = spark.createDataFrame([(C, k, str(k), n, json.dumps(a)) for k, (n, a) in enumerate(CALLS)], "sha string, k int, id string, name string, arguments string")
    got = {r["k"]: json.loads(r["content"]) for r in reviews.answers(reviews.read_requests(calls), names, *repo).collect()}
    kit = tools.Tools(*repo, C)
    for k, (name, args) in enumerate(CALLS):
        try:
            want = {"ok": True, "result": kit.execute(name, args)}
        except ValueError as why:
            want = {"ok": False, "error": f"ValueError: {why}"}
        assert got[k] == json.loads(json.dumps(want)), (name, args)
    assert len(got) == len(CALLS)


def test_reviews(spark, repo):
    limits = reviews.Limits(turns=4, calls=9, bytes=2_000, result_bytes=700)
    plans = {
        C: {"turns": 3, "each": 3, "from": 5}, P: {"turns": 9, "each": 1, "from": 0}, H: {"turns": 3, "each": 5, "from": 11}, X: {"turns": 2, "each": 2, "from": 24, "fail": 1},
    }
    more = [{C: {"turns": 9, "each": 5, "from": 21, "stubborn": True}, H: {"turns": 0, "each": 0, "from": 0}, P: {"turns": 4, "each": 2, "from": 0, "only": 22}}, {C: {"turns": 3, "each": 3, "from": 0, "only": 22}}]
    for each in (plans, *more):
        asked = spark.createDataFrame([(s, [json.dumps({"role": "user", "content": json.dumps(p)})]) for s, p in each.items()], "sha string, prompt array<string>")
        out = {r["sha"]: r for r in reviews.review(asked, script, *repo, limits).collect()}
        assert len(out) == len(each)
        for s, p in each.items():
            r = out[s]
            assert (r["status"], r["reason"], r["answer"], r["turns"], r["calls"], r["bytes"]) == one_by_one(repo, s, p, limits), (s, p)
            assert r["turns"] <= 4 and r["calls"] <= 9 and r["bytes"] <= 2_000


def test_limits_of_a_real_review(spark, repo):
    limits = reviews.Limits()
    assert (limits.turns, limits.calls, limits.bytes, limits.result_bytes) == (20, 60, 128_000, 32_000)
    loud = {"turns": 30, "each": 1, "from": 0, "only": 4}  # a diff of over 32,000 bytes a turn
    asked = spark.createDataFrame([(C, [json.dumps({"role": "user", "content": json.dumps(loud)})])], "sha string, prompt array<string>")
    r = reviews.review(asked, script, *repo).first()
    assert (r["status"], r["reason"], r["bytes"], r["calls"]) == ("stopped", "bytes", 128_000, 5)


def test_time_is_a_limit(spark, repo):
    def slow(messages, tools_on):
        import time

        time.sleep(0.2)
        return {"tool_calls": [{"id": "a", "name": "history", "arguments": {}}]}

    asked = spark.createDataFrame([(C, ["{}"])], "sha string, prompt array<string>")
    r = reviews.review(asked, slow, *repo, reviews.Limits(seconds=0.5)).first()
    assert (r["status"], r["reason"]) == ("stopped", "seconds") and 0.5 < r["seconds"] < 5
