"""A git repository as data sources: commits newest first, the files of a revision, the history and the blame of a file."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from prospector.functions.diffs import SECTION, change_of
from prospector.sources.records import COMMIT

#: What begins a commit in a stream of them, and what ends its message; neither a message nor a patch holds a NUL.
BEGIN, MESSAGE_END = b"\0\x01commit\0", b"\0\x01patch\0"
FORMAT = "%x00%x01commit%x00" + "%H%x00%P%x00%an%x00%ae%x00%aI%x00%cn%x00%ce%x00%cI%x00%B" + "%x00%x01patch%x00"
#: Commits that one enumeration may ask for, bytes of a patch, and those that a commit's other fields may take besides.
MOST_COMMITS, PATCH_BYTES, FIELD_BYTES = 100_000, 16 << 20, 64 << 10
STREAMED = StructType([*COMMIT.fields, StructField("place", LongType()), StructField("truncated", BooleanType())])
FULL_SHA = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}")


def git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, input=stdin).stdout


def canonical_source(source: str) -> str:
    """One spelling of a repository: file URI of a local path, URL with a lower-case host, or host:path as it is.

    Credentials, queries, fragments and other schemes are refused.
    """
    s = str(source).strip()
    if not s or any(ord(c) < 32 or ord(c) == 127 for c in s):
        raise ValueError("empty source or control characters")
    local = Path(s).expanduser()
    if local.exists():
        return local.resolve().as_uri()
    u = urlsplit(s)
    if "://" not in s and ":" in s and "/" not in s.split(":")[0]:
        return s
    if u.scheme not in ("http", "https", "ssh", "git") or not u.hostname:
        raise ValueError("neither a local path nor a URL of http, https, ssh or git")
    if u.password is not None or (u.username is not None and u.scheme != "ssh") or u.query or u.fragment:
        raise ValueError("credentials, query or fragment in the URL")
    if u.path in ("", "/"):
        raise ValueError("the URL names no repository")
    user = f"{u.username}@" if u.username else ""
    return f"{u.scheme}://{user}{u.hostname}{f':{u.port}' if u.port else ''}{u.path.rstrip('/')}"


def source_key(source: str) -> str:
    return hashlib.sha256(canonical_source(source).encode()).hexdigest()


def checked(revision: str) -> str:
    if not revision or revision.startswith("-") or any(c.isspace() for c in revision):
        raise ValueError("not a revision")
    return revision


def default_branch(path: str) -> str:
    """What HEAD names, else main, else master, else the branch with the newest commit."""
    names = git(path, "for-each-ref", "--sort=-committerdate", "--format=%(refname:short)", "refs/heads").decode().split()
    head = subprocess.run(["git", "-C", path, "symbolic-ref", "--short", "-q", "HEAD"], capture_output=True).stdout.decode().strip()
    for name in (head, "main", "master", *names):
        if name in names:
            return name
    raise ValueError("no branches")


def changed_paths(raw: str) -> list[tuple]:
    """(status, path, old path) from name-status fields; renames and copies take two paths."""
    out, fields = [], iter(raw.split("\0"))
    for status in fields:
        if not status:
            continue
        if status[0] in "RC":
            old = next(fields)
            out.append((status, next(fields), old))
        else:
            out.append((status, next(fields), None))
    return out


class Slice(InputPartition):
    def __init__(self, shas: list, place: int = 0):
        self.shas, self.place = shas, place


def resolve(path: str, revision: str) -> str:
    """The full id of the commit that a revision names."""
    return git(path, "rev-parse", "--verify", "--quiet", f"{checked(revision)}^{{commit}}").decode().strip().lower()


def checked_since(since: str) -> str:
    if not since or len(since) > 128 or since.startswith("-") or any(ord(c) < 32 or ord(c) == 127 for c in since):
        raise ValueError("not a date")
    return since


def mirror(source: str, root: str) -> str:
    """Where a repository is read from: a local one in place, another from a bare mirror under root, which is made or brought up to
    date. A mirror is made beside its place and moved there whole."""
    canonical = canonical_source(source)
    if canonical.startswith("file://"):
        return str(Path(source).expanduser().resolve())
    place = Path(root) / f"{source_key(source)}.git"
    if place.exists():
        git(str(place), "remote", "update", "--prune")
    else:
        place.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=place.parent) as made:
            subprocess.run(["git", "clone", "--quiet", "--mirror", "--", canonical, f"{made}/new"], check=True, capture_output=True)
            os.replace(f"{made}/new", place)
    return str(place)


def snapshot(source: str, root: str) -> dict[str, str]:
    """What a scan of a repository is pinned to: its key, canonical source, folder, default branch and that branch's commit."""
    path = mirror(source, root)
    branch = default_branch(path)
    return {"repository": source_key(source), "canonical_source": canonical_source(source), "path": path, "default_branch": branch, "head_sha": resolve(path, branch)}


def frames(chunks: Iterable[bytes], most: int, mark: bytes = BEGIN) -> Iterator[tuple[bytes, bool]]:
    """(record, truncated) of each record that follows a mark, however the stream is cut into chunks. Of a record of over `most` bytes
    only the head is kept, and never more than that and a chunk is held."""
    rest, head, begun = b"", None, False
    for chunk in chunks:
        rest += chunk
        while (at := rest.find(mark)) >= 0:
            if begun:
                yield (rest[: min(at, most)], at > most) if head is None else (head, True)
            rest, head, begun = rest[at + len(mark) :], None, True
        if begun and head is None and len(rest) > most + len(mark):
            head = rest[:most]
        if not begun or head is not None:
            rest = rest[1 - len(mark) :]  # what may begin a mark
    if begun:
        yield (rest[:most], len(rest) > most) if head is None else (head, True)


def decoded(record: bytes, truncated: bool) -> tuple:
    """A commit's columns but place and patch id from its record; the patch begins after the line that ends the message and a blank one."""
    header, end, patch = record.partition(MESSAGE_END)
    fields = header.decode("utf-8", "replace").split("\0", 8)
    if not end or len(fields) != 9 or not FULL_SHA.fullmatch(fields[0].lower()):
        raise ValueError("malformed commit record")
    parents = [p.lower() for p in fields[1].split()]
    if not all(map(FULL_SHA.fullmatch, parents)):
        raise ValueError("malformed commit parents")
    patch = patch.removeprefix(b"\n").removeprefix(b"\n")
    paths = [change_of(x) for x in SECTION.split(patch.decode("utf-8", "replace")) if x.startswith("diff --")]
    return fields[0].lower(), parents, fields[8].rstrip("\n"), *fields[2:8], paths, patch, truncated


def streamed(path: str, shas: list[str], patches: bool = True, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The output of one process for many commits, merges against their first parent."""
    show = ["--patch", "--diff-merges=first-parent", "--find-renames", "--no-ext-diff", "--no-textconv", "--binary", "--full-index"] if patches else ["--no-patch"]
    with tempfile.TemporaryFile() as wanted:
        wanted.write("\n".join(shas).encode())
        wanted.seek(0)
        run = subprocess.Popen(["git", "-C", path, "log", "--no-walk=unsorted", "--no-show-signature", *show, f"--format={FORMAT}", "--stdin"], stdin=wanted, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        with run.stdout as out:
            while part := out.read(chunk):
                yield part
        if run.wait():
            raise ValueError("git log failed")


class GitReader(DataSourceReader):
    """Options: path; revision (the default branch) or range A..B; last, at most so many, 1 to 100,000; since, a date; slice, commits a
    partition; patches (true); patch_ids (false), a process for each commit; max_patch_bytes, longer patches are cut.

    The commits are listed once, newest first, and pinned by their ids; each partition reads its own from one process.
    """

    def __init__(self, options):
        self.path = options["path"]
        if "range" in options and "revision" in options:
            raise ValueError("range and revision exclude each other")
        self.revision = checked(options.get("range") or options.get("revision") or default_branch(self.path))
        self.patch_ids, self.patches = options.get("patch_ids", "false") == "true", options.get("patches", "true") == "true"
        if "last" in options and not 1 <= int(options["last"]) <= MOST_COMMITS:
            raise ValueError(f"last is 1 to {MOST_COMMITS}")
        self.args = [f"--max-count={int(options['last'])}"] if "last" in options else []
        self.args += [f"--since={checked_since(options['since'])}"] if "since" in options else []
        self.slice, self.most = int(options.get("slice", 500)), int(options.get("max_patch_bytes", PATCH_BYTES))

    def partitions(self):
        shas = git(self.path, "rev-list", "--topo-order", "--date-order", *self.args, self.revision, "--").decode().split()
        return [Slice(shas[k : k + self.slice], k) for k in range(0, len(shas), self.slice)] or [Slice([])]

    def read(self, partition):
        yield from records(self.path, partition, self.patches, self.patch_ids, self.most)


def records(path: str, part: Slice, patches: bool, patch_ids: bool, most: int) -> Iterator[tuple]:
    """The rows of a slice of commits, from one process and one commit at a time."""
    if not part.shas:
        return
    for place, frame in enumerate(frames(streamed(path, part.shas, patches), most + FIELD_BYTES), part.place):
        *columns, patch, truncated = decoded(*frame)
        cut = truncated or len(patch) > most
        same = git(path, "patch-id", "--stable", stdin=patch).decode().split()[:1] if patch_ids and patch and not cut else []
        yield (*columns, patch[:most], same[0] if same else None, place, cut)


class GitStream(DataSourceStreamReader):
    """Commits as they come. Options: path; refs, a pattern of references (refs/heads); slice, patches, patch_ids and max_patch_bytes as
    for a batch; after, revisions with blanks between, whose history is not read.

    An offset is the set of heads that has been read. A batch holds what the new heads reach and the old ones don't, oldest first, so
    each commit comes once, whatever branches are made, merged or moved, and a restart goes on from the heads in its checkpoint. Old heads
    that are no longer in the repository are left out; commits that only they reached and that are still there come no second time
    only if another old head reaches them.
    """

    def __init__(self, options):
        self.path, self.refs = options["path"], options.get("refs", "refs/heads")
        if self.refs.startswith("-"):
            raise ValueError("not a pattern of references")
        self.after = [resolve(self.path, r) for r in options.get("after", "").split()]
        self.patch_ids, self.patches = options.get("patch_ids", "false") == "true", options.get("patches", "true") == "true"
        self.slice, self.most = int(options.get("slice", 500)), int(options.get("max_patch_bytes", PATCH_BYTES))

    def initialOffset(self) -> dict:
        return {"heads": " ".join(sorted(self.after))}

    def latestOffset(self) -> dict:
        heads = git(self.path, "for-each-ref", "--format=%(objectname) %(*objectname)", self.refs).decode().splitlines()
        return {"heads": " ".join(sorted({h.split()[-1] for h in heads} | set(self.after)))}

    def partitions(self, start: dict, end: dict):
        old, new = (self.there(o["heads"].split()) for o in (start, end))
        if not new:
            return []
        asked = "\n".join([*new, *(f"^{h}" for h in old)]).encode()
        shas = git(self.path, "rev-list", "--topo-order", "--date-order", "--reverse", "--stdin", stdin=asked).decode().split()
        return [Slice(shas[k : k + self.slice], k) for k in range(0, len(shas), self.slice)]

    def there(self, heads: list[str]) -> list[str]:
        """Those of heads that are commits of the repository."""
        if not heads:
            return []
        said = git(self.path, "cat-file", "--batch-check=%(objectname) %(objecttype)", stdin="\n".join(heads).encode()).decode().splitlines()
        return [line.split()[0] for line in said if line.endswith(" commit")]

    def read(self, partition):
        yield from records(self.path, partition, self.patches, self.patch_ids, self.most)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


def commit_at(spark: SparkSession, path: str, revision: str, patches: bool = True) -> DataFrame:
    """The one commit that a revision names; without its patch if that is not wanted."""
    return spark.read.format("git_commits").option("path", path).option("revision", resolve(path, revision)).option("last", 1).option("patches", str(patches).lower()).load()


class GitSource(DataSource):
    """spark.dataSource.register(GitSource); spark.read or spark.readStream .format("git_commits").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self):
        return STREAMED

    def reader(self, schema):
        return GitReader(self.options)

    def streamReader(self, schema):
        return GitStream(self.options)


class FilesReader(DataSourceReader):
    """Options: path; revision (HEAD); prefix; max_paths, more fail; max_bytes, larger files have null content; slice."""

    def __init__(self, options):
        self.path, self.revision = options["path"], checked(options.get("revision", "HEAD"))
        self.prefix, self.slice = options.get("prefix", ""), int(options.get("slice", 1000))
        self.max_paths, self.max_bytes = int(options.get("max_paths", 1_000_000)), int(options.get("max_bytes", 16 << 20))

    def partitions(self):
        listed = git(self.path, "ls-tree", "-r", "-l", "-z", "--full-tree", self.revision).decode("utf-8", "replace").split("\0")
        rows = []
        for entry in filter(None, listed):
            facts, name = entry.split("\t", 1)
            _, kind, blob, size = facts.split()
            if kind == "blob" and name.startswith(self.prefix):
                rows.append((name, blob, int(size)))
        if len(rows) > self.max_paths:
            raise ValueError(f"{len(rows)} paths, more than {self.max_paths}")
        return [Slice(rows[k : k + self.slice]) for k in range(0, len(rows), self.slice)] or [Slice([])]

    def read(self, partition):
        run = subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        for name, blob, size in partition.shas:
            content = None
            if size <= self.max_bytes:
                run.stdin.write(f"{blob}\n".encode())
                run.stdin.flush()
                content = run.stdout.read(int(run.stdout.readline().split()[2]) + 1)[:-1]
            yield (name, blob, size, content)
        run.communicate()


class GitFiles(DataSource):
    """spark.read.format("git_files").option("path", ...).load(): (path, blob, size, content) of every file of a revision."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self):
        return "path string, blob string, size long, content binary"

    def reader(self, schema):
        return FilesReader(self.options)


def blobs_at(wanted: DataFrame, path: str, most: int = 16 << 20) -> DataFrame:
    """wanted (sha, path) with content: the file at that commit as text, null where there is none or it is over `most` bytes. Each partition
    asks one process; files are asked for one by one and held one at a time."""

    def read(batches):
        run = subprocess.Popen(["git", "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        for b in batches:
            out = []
            for sha, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                content = None
                if sha and name and "\n" not in name:
                    run.stdin.write(f"{sha}:{name}\n".encode())
                    run.stdin.flush()
                    *_, kind, size = run.stdout.readline().decode("utf-8", "replace").split() or ("", "")
                    if kind in ("blob", "tree", "commit", "tag"):
                        whole = run.stdout.read(int(size) + 1)[:-1]
                        content = whole.decode("utf-8", "replace") if kind == "blob" and len(whole) <= most else None
                out.append(content)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["sha", "path", "content"])
        run.communicate()

    return wanted.select("sha", "path").mapInArrow(read, "sha string, path string, content string")


class HistoryReader(DataSourceReader):
    """Options: path; file; revision (HEAD); last (20), at most 100. One file's history is one task."""

    def __init__(self, options):
        self.path, self.file, self.revision = options["path"], options["file"], checked(options.get("revision", "HEAD"))
        self.last = int(options.get("last", 20))
        if not 1 <= self.last <= 100:
            raise ValueError("last is 1 to 100")

    def read(self, partition):
        out = git(self.path, "log", f"--max-count={self.last}", "--follow", "-M", "--name-status", "-z", "--format=%x01%H%x00%cI%x00%s%x00", self.revision, "--", self.file).decode("utf-8", "replace")
        for seq, entry in enumerate(out.split("\x01")[1:]):
            sha, at, subject, names = entry.split("\0", 3)
            status, path, old = changed_paths(names.strip("\n\0") + "\0")[0]
            yield (seq, sha, at, subject, status, path, old)


class GitHistory(DataSource):
    """spark.read.format("git_history").option("path", ...).option("file", ...).load(): commits of a file, renames followed."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self):
        return "seq int, sha string, committer_time string, subject string, status string, path string, old_path string"

    def reader(self, schema):
        return HistoryReader(self.options)


class BlameReader(DataSourceReader):
    """Options: path; file; revision (HEAD); start (1), end (start + 999): at most 1,000 lines."""

    def __init__(self, options):
        self.path, self.file, self.revision = options["path"], options["file"], checked(options.get("revision", "HEAD"))
        self.start = int(options.get("start", 1))
        self.end = int(options.get("end", self.start + 999))
        if self.start < 1 or not self.start <= self.end < self.start + 1000:
            raise ValueError("a range of 1 to 1,000 lines")

    def read(self, partition):
        text = git(self.path, "show", f"{self.revision}:{self.file}").decode("utf-8", "replace")
        last = min(self.end, text.count("\n") + (not text.endswith("\n")))
        if self.start > last:
            return
        out = git(self.path, "blame", "--line-porcelain", f"-L{self.start},{last}", self.revision, "--", self.file).decode("utf-8", "replace")
        sha = line = None
        for row in out.split("\n"):
            if row.startswith("\t"):
                yield (line, sha, row[1:])
                sha = None
            elif sha is None and row:
                sha, _, line = row.split(" ")[:3]
                line = int(line)


class GitBlame(DataSource):
    """spark.read.format("git_blame").option("path", ...).option("file", ...).load(): who touched each line last."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self):
        return "line int, sha string, text string"

    def reader(self, schema):
        return BlameReader(self.options)


def register(spark) -> None:
    for source in (GitSource, GitFiles, GitHistory, GitBlame):
        spark.dataSource.register(source)


def commits_in(stream: Column, most: int = PATCH_BYTES) -> Column:
    """The commits of a binary column that holds streams of them as `git log` with FORMAT writes: (sha, parents, message, changed_paths,
    patch, truncated)."""

    @pandas_udf("array<struct<sha:string,parents:array<string>,message:string,changed_paths:array<struct<status:string,path:string,old_path:string>>,patch:binary,truncated:boolean>>")
    def run(streams: pd.Series) -> pd.Series:
        def commits(x):
            rows = (decoded(*frame) for frame in frames([bytes(x)], most + FIELD_BYTES))
            return [(sha, parents, message, paths, patch[:most], cut or len(patch) > most) for sha, parents, message, *_, paths, patch, cut in rows]

        return streams.map(lambda x: None if x is None else commits(x))

    return run(stream)
