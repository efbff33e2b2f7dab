"""Reviews of many commits at once: rounds over a table of open conversations, in which a model asks for bounded reads of the repository.

In a round every open conversation has one turn. All that the turns ask for is answered together, by joins with the tables of commits,
files and blame, and each conversation carries what it has used of its limits. tables are those of tools.Tools, which reads one by one.
"""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospector.functions.text import squeeze
from prospector.operators import tools
from prospector.operators.graph import cut
from prospector.operators.stages import model_turn


@dataclasses.dataclass(frozen=True)
class Limits:
    """What one conversation may use. Fixed values."""

    turns: int = 20
    calls: int = 60
    bytes: int = 128_000
    result_bytes: int = 32_000
    seconds: float = 240.0


#: What a model is told when its calls are used up; it has one more turn then.
NO_MORE = "No further tool calls are answered. Give the final decision now from what has been read; abstain with insufficient_evidence if that is too little."
#: Conversations of one task.
SPOKEN = 20_000
STATE = "sha string, commit string, parent string, head string, messages array<string>, turns int, calls int, bytes long, seconds double, forced boolean, status string, reason string, answer string, requests array<struct<id:string,name:string,arguments:string>>, granted int"
REQUEST = "sha string, k int, id string, name string, revision string, other string, path string, first int, last int, query string, top int, supports array<string>, problem string"


def said(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def clipped(text: str, most: int) -> str:
    return text.encode()[:most].decode("utf-8", "ignore")


def taken_in(row: dict[str, Any], limits: Limits) -> None:
    """Put the answers of the last round (k, content) into the messages, as far as bytes are left."""
    told = {a["k"]: a["content"] for a in row["answers"] or []}
    for k, request in enumerate(row["requests"] or []):
        if k == row["granted"]:  # beyond the calls that were left
            row["messages"] += [said({"role": "tool", "tool_call_id": request["id"], "content": said({"ok": False, "error": "no calls are left"})}), said({"role": "user", "content": NO_MORE})]
            row["forced"] = True
            return
        left = limits.bytes - row["bytes"]
        if left <= 0:
            row |= {"status": "stopped", "reason": "bytes"}
            return
        text = clipped(told[k], min(limits.result_bytes, left))
        row["bytes"] += len(text.encode())
        row["messages"].append(said({"role": "tool", "tool_call_id": request["id"], "name": request["name"], "content": text}))


def turn(row: dict[str, Any], model: Callable[..., Any], limits: Limits) -> None:
    """One turn of a conversation: its state after the model has spoken, with what it asks for."""
    began = time.monotonic()
    try:
        told = model_turn(model([json.loads(m) for m in row["messages"]], not row["forced"]))
    except Exception as why:  # a model that fails ends its own conversation only
        row |= {"status": "stopped", "reason": f"model_error:{type(why).__name__}", "requests": []}
        return
    finally:
        row["turns"] += 1
        row["seconds"] += time.monotonic() - began
    asked = [{"id": c["id"], "name": c["name"], "arguments": said(c["arguments"])} for c in told["tool_calls"]]
    row["requests"] = asked
    if row["seconds"] > limits.seconds:
        row |= {"status": "stopped", "reason": "seconds", "requests": []}
    elif not asked:
        row |= {"status": "answered", "answer": told["content"] if isinstance(told["content"], str) or told["content"] is None else said(told["content"])}
    elif row["forced"]:
        row |= {"status": "stopped", "reason": "calls", "requests": []}
    else:
        row["messages"].append(said({"role": "assistant", "content": told["content"], "tool_calls": asked}))
        row["granted"] = min(len(asked), limits.calls - row["calls"])
        row["calls"] += row["granted"]


def spoken(state: DataFrame, model: Callable[..., Any], limits: Limits) -> DataFrame:
    """The state of open conversations (and answers) after a turn of each."""
    names = [x.split(" ")[0] for x in STATE.split(", ")]
    kinds = pa.schema([(f.name, t) for f, t in zip(state.sparkSession.createDataFrame([], STATE).schema.fields, ARROW, strict=True)])

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for row in rows:
                taken_in(row, limits)
                if row["status"] == "open" and row["turns"] >= limits.turns:
                    row |= {"status": "stopped", "reason": "turns"}
                if row["status"] == "open":
                    turn(row, model, limits)
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], kinds)

    return state.mapInArrow(run, STATE)


S, I32, I64 = pa.string(), pa.int32(), pa.int64()
ARROW = [S, S, S, S, pa.list_(S), I32, I32, I64, pa.float64(), pa.bool_(), S, S, S, pa.list_(pa.struct([("id", S), ("name", S), ("arguments", S)])), I32]


# --- what is asked for


def read_request(name: str, arguments: str) -> dict[str, Any]:
    """The columns of REQUEST of one call; raises for one that no tool knows."""
    args = json.loads(arguments)
    if name not in tools.TOOLS:
        raise ValueError(f"no such tool: {name}")
    if extra := sorted(set(args) - set(tools.TOOLS[name][1])):
        raise ValueError("unknown argument(s): " + ", ".join(extra))
    if name == "linked_artifact":
        raise ValueError("linked artifacts are unavailable in this profile")
    out: dict[str, Any] = {"revision": tools.words(args.get("revision", "commit"), "revision").strip().lower()}
    if args.get("parent") is not None:
        out["other"] = tools.words(args["parent"], "revision").strip().lower()
    if name in ("read_blob", "read_range", "cite", "blame") or args.get("path") is not None:
        out["path"] = tools.relative(args.get("path"))
    if name == "list_paths" and args.get("prefix") is not None:
        out["path"] = tools.relative(args["prefix"])
    if name in ("read_range", "cite", "blame"):
        out["first"], out["last"] = tools.span(args, tools.CITED_LINES if name == "cite" else tools.READ_LINES)
    if name in ("search", "list_paths", "history"):
        out["top"] = tools.whole(args.get("limit", tools.RESULTS if name == "list_paths" else 20), "limit", tools.RESULTS)
    if name == "search":
        out["query"] = tools.words(args.get("query"), "query")
        if len(out["query"]) > tools.QUERY_CHARS:
            raise ValueError(f"query exceeds {tools.QUERY_CHARS} characters")
    if name == "cite":
        claims = args.get("supports")
        out["supports"] = [str(c) for c in claims if str(c).strip()] if isinstance(claims, list) else []
        if not out["supports"] or set(out["supports"]) - set(tools.CLAIMS):
            raise ValueError("supports must name at least one claim, and only known ones: " + ", ".join(tools.CLAIMS))
    return out


def read_requests(calls: DataFrame) -> DataFrame:
    """Calls (sha, k, id, name, arguments) as REQUEST rows; problem says why one can't be answered."""
    kinds = pa.schema([(x.split(" ")[0], {"int": I32, "array<string>": pa.list_(S)}.get(x.split(" ")[1], S)) for x in REQUEST.split(", ")])

    def run(batches):
        for b in batches:
            rows = []
            for c in b.to_pylist():
                row = dict.fromkeys(kinds.names) | {n: c[n] for n in ("sha", "k", "id", "name")}
                try:
                    row |= read_request(c["name"], c["arguments"])
                except ValueError as why:
                    row["problem"] = str(why)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return calls.mapInArrow(run, REQUEST)


def resolved(requests: DataFrame, names: DataFrame, commits: DataFrame, said_in: str, to: str) -> DataFrame:
    """requests with the commit that a revision means in column `to`: a name of the conversation (commit, parent, head), or the beginning of
    one id. names: (sha, commit, parent, head)."""
    r = requests.join(names, "sha")
    word = F.col(said_in)
    named = F.when(word == "commit", F.col("commit")).when(word == "parent", F.col("parent")).when(word == "head", F.col("head"))
    short = r.where(named.isNull() & (F.length(word) >= 7)).select("sha", "k", word.alias("_said"), F.substring(word, 1, 7).alias("_start"))
    ids = commits.select(F.col("sha").alias("_id"), F.substring("sha", 1, 7).alias("_start"))
    found = short.join(ids, "_start").where(F.startswith("_id", "_said")).groupBy("sha", "k").agg(F.min("_id").alias("_id"), F.count("*").alias("_n")).where("_n = 1")
    out = r.join(found.select("sha", "k", "_id"), ["sha", "k"], "left").withColumn(to, F.coalesce(named, "_id"))
    root = F.when(word == "parent", F.lit("this is a root commit; it has no parent revision")).otherwise(F.concat(F.lit("not a revision: "), word))
    return out.withColumn("problem", F.coalesce("problem", F.when(word.isNotNull() & F.col(to).isNull(), root))).drop("commit", "parent", "head", "_id")


def lines_of(content: Column, first: Column, last: Column) -> Column:
    """Lines of a text; what follows its last line break is none."""
    every = F.split(content, "\r\n|\n|\r")
    every = F.when(content.rlike(r"[\r\n]\z"), F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)
    return F.slice(every, first, last - first + 1)


def answers(requests: DataFrame, names: DataFrame, commits: DataFrame, files: DataFrame, blame: DataFrame) -> DataFrame:
    """(sha, k, content) of all requests, content as JSON: ok and result, or ok and error. Each tool is one join over all that ask for it;
    a list has its request's limit of rows, taken by a window, and files are read where they lie."""
    r = resolved(requests, names, commits, "revision", "at")
    r = cut(resolved(r, names, commits, "other", "other_at"))
    fine = r.where("problem IS NULL")
    of = lambda *which: fine.where(F.col("name").isin(*which))
    ok = lambda value: F.to_json(F.struct(F.lit(True).alias("ok"), value.alias("result")), {"ignoreNullFields": "false"})
    no = lambda text: F.to_json(F.struct(text.alias("error"), F.lit(False).alias("ok")))
    rows = lambda *fields: F.struct(*[F.col(f) for f in fields])
    parts = [r.where("problem IS NOT NULL").select("sha", "k", no(F.concat(F.lit("ValueError: "), "problem")).alias("content"))]

    c = commits.withColumnRenamed("sha", "at")
    shown = of("show_commit").join(c, "at")
    parts.append(shown.select("sha", "k", ok(F.struct("changed_paths", "committer_time", "message", "parents", F.col("at").alias("sha"))).alias("content")))
    diff = of("show_diff").join(c, "at")
    other = F.col("other_at").isNotNull() & ~F.col("other_at").eqNullSafe(F.try_element_at("parents", F.lit(1)))
    text = F.make_valid_utf8(F.substring("patch", 1, tools.RESULT_BYTES).cast("string"))
    result = ok(F.struct(text.alias("diff"), F.col("at").alias("revision"), (F.length("patch") > tools.RESULT_BYTES).alias("truncated")))
    parts.append(diff.select("sha", "k", F.when(other, no(F.lit("ValueError: only the first parent is compared with"))).otherwise(result).alias("content")))

    f = files.select(F.col("sha").alias("at"), "path", F.col("content").cast("string").alias("content"), F.octet_length("content").alias("size"))
    read = of("read_blob", "read_range", "cite").join(f, ["at", "path"], "left")
    none = F.col("size").isNull() & F.col("content").isNull()
    big = (F.col("name") == "read_blob") & (F.col("size") > tools.RESULT_BYTES)
    own = lines_of(F.coalesce("content", F.lit("")), F.col("first"), F.col("last"))
    ranged = F.struct(
        F.col("last").alias("end_line"), F.transform(own, lambda x, i: F.struct((F.col("first") + i).alias("n"), x.alias("text"))).alias("lines"), F.lit(tools.NUMBERED).alias("note"), "path",
        F.col("at").alias("revision"), F.col("first").alias("start_line"),
    )
    quote = F.rtrim(F.substring(squeeze(F.array_join(own, "\n")), 1, tools.QUOTE_CHARS))
    named = read.join(names, "sha")
    side = F.when(F.col("at") == F.col("commit"), "commit").when(F.col("at") == F.col("parent"), "parent").when(F.col("at") == F.col("head"), "head")
    anchor = F.struct(F.col("last").alias("end_line"), "path", quote.alias("quoted_span"), side.alias("revision"), F.col("at").alias("revision_sha"), F.col("first").alias("start_line"), "supports")
    cited = ok(F.struct(anchor.alias("anchor"), F.lit(tools.VERBATIM).alias("note")))
    wrong = (
        F.when(none, F.concat(F.lit("no file "), "path", F.lit(" at "), "at")).when(big, F.concat("path", F.lit(" has "), "size", F.lit(f" bytes, more than {tools.RESULT_BYTES}; read a range of it")))
        .when((F.col("name") == "cite") & (quote == ""), F.concat("path", F.lit(":"), "first", F.lit("-"), "last", F.lit(" is blank; cite a line that contains the evidence")))
        .when((F.col("name") == "cite") & side.isNull(), "evidence is of the commit, its first parent, or the head")
    )
    result = F.when(F.col("name") == "read_blob", ok(F.col("content"))).when(F.col("name") == "read_range", ok(ranged)).otherwise(cited)
    parts.append(named.select("sha", "k", F.when(wrong.isNotNull(), no(F.concat(F.lit("ValueError: "), wrong))).otherwise(result).alias("content")))

    def listed(hits: DataFrame, asked: DataFrame, order: list[str], item: Column, wrap: Callable[[Column], Column] = ok) -> DataFrame:
        """The first rows of each request in order, up to its limit, as one answer; no hits are an empty list."""
        w = Window.partitionBy("sha", "k").orderBy(*order)
        few = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.coalesce("top", F.lit(tools.READ_LINES)))
        held = few.groupBy("sha", "k").agg(F.array_sort(F.collect_list(F.struct("_rn", item.alias("x")))).alias("l"))
        out = asked.join(held, ["sha", "k"], "left")
        x = F.transform("l", lambda y: y["x"])
        return out.select("sha", "k", wrap(F.coalesce(x, F.expr("array()").cast(held.select(x.alias("x")).schema["x"].dataType))).alias("content"))

    hunt = of("search")
    within = hunt.join(f.withColumnRenamed("path", "file"), "at").where(F.col("path").isNull() | (F.col("path") == F.col("file")))
    each = within.where(F.contains("content", "query")).select("sha", "k", "top", "query", F.col("file"), F.posexplode(F.split("content", "\n")).alias("line", "text")).where(F.contains("text", "query"))
    parts.append(listed(each.select("sha", "k", "top", (F.col("line") + 1).alias("line"), F.col("file").alias("path"), "text"), hunt, ["path", "line"], rows("line", "path", "text")))

    tree = of("list_paths")
    named = tree.join(f.select("at", F.col("path").alias("file")), "at").where(F.col("path").isNull() | F.startswith("file", "path"))
    total = named.groupBy("sha", "k").agg(F.count("*").alias("total"))
    wrap = lambda x: ok(F.struct(x.alias("paths"), F.col("path").alias("prefix"), F.col("at").alias("revision"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) > F.col("top")).alias("truncated")))
    parts.append(listed(named, tree.join(total, ["sha", "k"], "left"), ["file"], F.col("file"), wrap))

    past = of("history").join(commits.select(F.col("sha").alias("at"), F.col("place").alias("from")), "at")
    told = commits.select(F.col("sha").alias("found"), "place", "committer_time", F.substring_index("message", "\n", 1).alias("subject"), "changed_paths")
    near = past.where("path IS NULL").withColumn("place", F.explode(F.sequence("from", F.col("from") + F.col("top") - 1))).join(told.drop("changed_paths"), "place")
    touched = told.select("found", "place", "committer_time", "subject", F.explode(F.array_distinct(F.flatten(F.transform("changed_paths", lambda p: F.array(p["path"], p["old_path"]))))).alias("path")).where("path IS NOT NULL")
    along = past.join(touched, "path").where(F.col("place") >= F.col("from"))
    hits = near.select("sha", "k", "top", "found", "place", "committer_time", "subject").unionByName(along.select("sha", "k", "top", "found", "place", "committer_time", "subject"))
    parts.append(listed(hits, past, ["place"], F.struct("committer_time", F.col("found").alias("sha"), "subject")))

    look = of("blame")
    hits = look.join(blame.select(F.col("sha").alias("at"), "path", "line", F.col("commit").alias("by")), ["at", "path"]).where(F.col("line").between(F.col("first"), F.col("last")))
    parts.append(listed(hits, look, ["line"], F.struct(F.col("by").alias("commit"), "line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def review(candidates: DataFrame, model: Callable[..., Any], commits: DataFrame, files: DataFrame, blame: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(sha, status, reason, answer, turns, calls, bytes, seconds, messages) of candidates (sha, prompt array<string>, messages as JSON).

    model(messages, tools) is called on executors and gives a turn as stages.model_turn() reads it; tools is false once no call is
    answered any more. status is answered, or stopped with the limit as reason: turns, calls (after one last turn), bytes or seconds of
    the model, or model_error. A round is written before the next one, so no turn is paid for twice, and ended conversations go on no
    further; there are at most limits.turns + 1 rounds. Candidates need a place among commits and come once each.
    """
    limits = limits or Limits()
    head = commits.agg(F.min_by("sha", "place")).first()[0]
    own = commits.select("sha", F.try_element_at("parents", F.lit(1)).alias("parent"))
    state = candidates.join(own, "sha").withColumn("head", F.lit(head))
    given = {"commit": F.col("sha"), "messages": F.col("prompt"), "turns": F.lit(0), "calls": F.lit(0), "bytes": F.lit(0).cast("long"), "seconds": F.lit(0.0), "forced": F.lit(False), "granted": F.lit(0), "status": F.lit("open"), "answers": F.lit(None).cast("array<struct<k:int,content:string>>")}
    state = state.withColumns(given).withColumns({c: F.lit(None).cast("string") for c in ("reason", "answer")}).withColumn("requests", F.lit(None).cast(state.sparkSession.createDataFrame([], STATE).schema["requests"].dataType))
    names = [x.split(" ")[0] for x in STATE.split(", ")]
    # a table of small rows is few tasks, but every row is a turn of a model
    parts = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // SPOKEN))
    ended = None
    while True:
        now = cut(spoken(state.select(*names, "answers").repartition(parts, "sha"), model, limits))
        over = now.where("status <> 'open'")
        ended = over if ended is None else ended.unionByName(over)
        state = now.where("status = 'open'")
        if not state.limit(1).count():
            break
        calls = state.select("sha", F.posexplode(F.slice("requests", F.lit(1), F.col("granted"))).alias("k", "c")).select("sha", "k", "c.id", "c.name", "c.arguments")
        got = answers(cut(read_requests(calls)), state.select("sha", "commit", "parent", "head"), commits, files, blame)
        held = got.groupBy("sha").agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "content")).alias("answers"))
        state = state.join(held, "sha", "left")
    return ended.select("sha", "status", "reason", "answer", "turns", "calls", "bytes", "seconds", "messages")
