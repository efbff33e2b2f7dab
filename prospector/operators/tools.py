"""Bounded reads that a reviewer of one commit may ask for, over tables of commits, files and blame.

commits: (sha, place, parents, message, committer_time, changed_paths, patch), place 0 the newest; files: (sha, path, content), the files at each
commit that is looked at; blame: (sha, path, line, commit). Every tool takes and gives JSON-like values and refuses what it doesn't know.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of a review, and the claims that evidence may support.
READ_LINES, RESULTS, RESULT_BYTES, QUERY_CHARS, CITED_LINES, QUOTE_CHARS = 400, 50, 32_000, 500, 3, 240
CLAIMS = ("reachability_delta", "failure_containment", "root_cause", "attacker_preconditions", "impact", "fix_effect", "l0_class", "cwe_id", "severity", "affected_paths", "fix_completeness", "invariant")
NUMBERED, VERBATIM = "Use `cite` with these line numbers to build evidence.", "Copy `anchor` verbatim into evidence[]. Do not edit it."


def whole(value: Any, name: str, most: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1 or (most and value > most):
        raise ValueError(f"{name} must be an integer from 1" + (f" to {most}" if most else ""))
    return value


def words(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty text")
    return value


def relative(value: Any) -> str:
    path = words(value, "path")
    if path.startswith("/") or "\0" in path or ".." in path.split("/") or len(path.encode()) > 4096:
        raise ValueError("path must be relative to the repository")
    return path


def span(args: Mapping[str, Any], most: int) -> tuple[int, int]:
    first, last = whole(args.get("start_line"), "start_line"), whole(args.get("end_line"), "end_line")
    if last < first:
        raise ValueError("end_line must be >= start_line")
    if last - first + 1 > most:
        raise ValueError(f"{last - first + 1} lines, more than {most}")
    return first, last


class Tools:
    """The tools for one commit. linked is asked only in profile A1."""

    def __init__(self, commits: DataFrame, files: DataFrame, blame: DataFrame, commit: str, profile: str = "A0", linked: Callable[[dict], Any] | None = None):
        self.commits, self.files, self.blamed, self.commit, self.profile, self.linked = commits, files, blame, commit, profile, linked
        row = commits.where(F.col("sha") == commit).select(F.try_element_at("parents", F.lit(1)).alias("p")).first()
        if row is None:
            raise ValueError("the commit is not known")
        self.parent, self.head = row["p"], commits.agg(F.min_by("sha", "place")).first()[0]
        self.issued: dict[tuple, dict] = {}

    def execute(self, name: str, args: Mapping[str, Any]) -> Any:
        """Run a tool by name with its arguments; others are refused."""
        tool = TOOLS.get(name)
        if tool is None:
            raise ValueError(f"no such tool: {name}")
        if extra := sorted(set(args) - set(tool[1])):
            raise ValueError("unknown argument(s): " + ", ".join(extra))
        return tool[0](self, dict(args))

    def at(self, args: Mapping[str, Any]) -> str:
        """A revision by name (commit, parent, head), or the one commit whose id it begins."""
        said = words(args.get("revision", "commit"), "revision").strip().lower()
        if said == "parent" and not self.parent:
            raise ValueError("this is a root commit; it has no parent revision")
        named = {"commit": self.commit, "parent": self.parent, "head": self.head}.get(said)
        if named:
            return named
        found = [r["sha"] for r in self.commits.where(F.col("sha").startswith(said)).select("sha").limit(2).collect()] if len(said) >= 7 else []
        if len(found) != 1:
            raise ValueError(f"not a revision: {said}")
        return found[0]

    def label(self, sha: str) -> str:
        names = {self.head: "head"} | ({self.parent: "parent"} if self.parent else {}) | {self.commit: "commit"}
        if sha not in names:
            raise ValueError("evidence is of the commit, its first parent, or the head")
        return names[sha]

    def content(self, sha: str, path: str) -> str:
        row = self.files.where((F.col("sha") == sha) & (F.col("path") == path)).select(F.col("content").cast("string").alias("c")).first()
        if row is None:
            raise ValueError(f"no file {path} at {sha}")
        return row["c"] or ""

    def lines(self, sha: str, path: str, first: int, last: int) -> list[str]:
        """Lines of a file, cut on the executors: only they come to the driver."""
        at = F.slice(F.split(F.col("content").cast("string"), "\r\n|\n|\r"), first, last - first + 1)
        row = self.files.where((F.col("sha") == sha) & (F.col("path") == path)).select(at.alias("l"), F.col("content").cast("string").rlike(r"[\r\n]\z").alias("ends"), F.size(F.split(F.col("content").cast("string"), "\r\n|\n|\r")).alias("n")).first()
        if row is None:
            raise ValueError(f"no file {path} at {sha}")
        over = row["ends"] and first + len(row["l"]) - 1 == row["n"]  # what follows the last line break is no line
        return list(row["l"][:-1] if over else row["l"])

    def show_commit(self, args):
        row = self.commits.where(F.col("sha") == self.at(args)).select("sha", "parents", "message", "committer_time", "changed_paths").first()
        return row.asDict(recursive=True)

    def show_diff(self, args):
        """A commit's patch against its first parent, at most RESULT_BYTES of it; another parent than the first is refused."""
        sha = self.at(args)
        row = self.commits.where(F.col("sha") == sha).select(F.try_element_at("parents", F.lit(1)).alias("p"), F.substring("patch", 1, RESULT_BYTES).alias("patch"), F.length("patch").alias("n")).first()
        if args.get("parent") is not None and self.at({"revision": args["parent"]}) != row["p"]:
            raise ValueError("only the first parent is compared with")
        return {"revision": sha, "diff": bytes(row["patch"]).decode("utf-8", "replace"), "truncated": row["n"] > RESULT_BYTES}

    def read_blob(self, args):
        sha, path = self.at(args), relative(args.get("path"))
        size = self.files.where((F.col("sha") == sha) & (F.col("path") == path)).select(F.octet_length("content").alias("n")).first()
        if size and size["n"] > RESULT_BYTES:
            raise ValueError(f"{path} has {size['n']} bytes, more than {RESULT_BYTES}; read a range of it")
        return self.content(sha, path)

    def read_range(self, args):
        sha, path, (first, last) = self.at(args), relative(args.get("path")), span(args, READ_LINES)
        rows = [{"n": first + k, "text": x} for k, x in enumerate(self.lines(sha, path, first, last))]
        return {"revision": sha, "path": path, "start_line": first, "end_line": last, "lines": rows, "note": NUMBERED}

    def cite(self, args):
        """An anchor whose quote comes from the file, not from the reviewer; it is remembered as issued."""
        sha, path, (first, last) = self.at(args), relative(args.get("path")), span(args, CITED_LINES)
        claims = args.get("supports")
        claims = [str(c) for c in claims if str(c).strip()] if isinstance(claims, Sequence) and not isinstance(claims, (str, bytes)) else []
        if not claims or set(claims) - set(CLAIMS):
            raise ValueError("supports must name at least one claim, and only known ones: " + ", ".join(CLAIMS))
        quote = " ".join("\n".join(self.lines(sha, path, first, last)).split())[:QUOTE_CHARS].rstrip()
        if not quote:
            raise ValueError(f"{path}:{first}-{last} is blank; cite a line that contains the evidence")
        anchor = {"revision": self.label(sha), "revision_sha": sha, "path": path, "start_line": first, "end_line": last, "quoted_span": quote, "supports": claims}
        self.issued[(sha, path, first, last)] = anchor
        return {"anchor": anchor, "note": VERBATIM}

    def search(self, args):
        from prospector.sources.records import search

        query = words(args.get("query"), "query")
        if len(query) > QUERY_CHARS:
            raise ValueError(f"query exceeds {QUERY_CHARS} characters")
        limit, sha = whole(args.get("limit", 20), "limit", RESULTS), self.at(args)
        own = self.files.where(F.col("sha") == sha).withColumn("content", F.col("content").cast("string"))
        own = own.where(F.col("path") == relative(args["path"])) if args.get("path") is not None else own
        return [r.asDict() for r in search(own, query, limit).collect()]

    def list_paths(self, args):
        sha, limit = self.at(args), whole(args.get("limit", RESULTS), "limit", RESULTS)
        prefix = relative(args["prefix"]) if args.get("prefix") is not None else None
        own = self.files.where((F.col("sha") == sha) & F.col("path").startswith(prefix or "")).select("path")
        total = own.count()
        return {"revision": sha, "prefix": prefix, "total": total, "truncated": total > limit, "paths": [r["path"] for r in own.orderBy("path").limit(limit).collect()]}

    def history(self, args):
        """Commits from a revision on, newest first, or those that touch a path."""
        sha, limit = self.at(args), whole(args.get("limit", 20), "limit", RESULTS)
        place = self.commits.where(F.col("sha") == sha).select("place").first()["place"]
        own = self.commits.where(F.col("place") >= place)
        if args.get("path") is not None:
            path = relative(args["path"])
            own = own.where(F.exists("changed_paths", lambda p: (p["path"] == path) | (p["old_path"] == path)))
        return [r.asDict() for r in own.orderBy("place").limit(limit).select("sha", "committer_time", F.substring_index("message", "\n", 1).alias("subject")).collect()]

    def blame(self, args):
        sha, path, (first, last) = self.at(args), relative(args.get("path")), span(args, READ_LINES)
        own = self.blamed.where((F.col("sha") == sha) & (F.col("path") == path) & F.col("line").between(first, last))
        return [r.asDict() for r in own.orderBy("line").select("line", "commit").collect()]

    def linked_artifact(self, args):
        if self.profile != "A1" or self.linked is None:
            raise ValueError("linked artifacts are unavailable in this profile")
        asked = {k: words(v, k) for k, v in args.items() if v is not None}
        return self.linked(asked) if len(inspect.signature(self.linked).parameters) == 1 else self.linked(self.commit, asked)


#: The tools by name, and the arguments that each knows.
TOOLS = {
    "show_commit": (Tools.show_commit, ("revision",)), "show_diff": (Tools.show_diff, ("revision", "parent")), "read_blob": (Tools.read_blob, ("revision", "path")),
    "read_range": (Tools.read_range, ("revision", "path", "start_line", "end_line")), "cite": (Tools.cite, ("revision", "path", "start_line", "end_line", "supports")),
    "search": (Tools.search, ("query", "revision", "path", "limit")), "list_paths": (Tools.list_paths, ("revision", "prefix", "limit")), "history": (Tools.history, ("revision", "path", "limit")),
    "blame": (Tools.blame, ("revision", "path", "start_line", "end_line")), "linked_artifact": (Tools.linked_artifact, ("kind", "identifier")),
}
