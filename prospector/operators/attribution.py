"""Give findings on merge commits to the commits that the merges brought in, fold duplicates, and date introductions.

findings: (seq, sha, affected_paths array<string>, evidence array<struct<revision, revision_sha, path, start_line, end_line, quoted_span>>)
and other columns; seq is their order. commits: (sha, place, parents, paths, added, patch_id); place is after that of all parents, added
holds added_lines() of the patch. blobs: (sha, path, content).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospector.functions.text import squeeze
from prospector.operators import graph, reach

#: A merge that brings in more commits than this is not resolved.
MOST = 25
#: Evidence of fewer lines than this is blamed, which is all of it: there is no bound.
BLAME_LINES = math.inf
#: Rows of blame that a task holds.
BLAME_ROWS = 500_000
#: Lines of a block in which ranges of lines and runs of blame meet.
BLAME_BLOCK = 64
#: Blocks that a range reaches over at most before it is cut to its file, and what it has of whole blocks is looked up once for all ranges.
BLAME_FAR = 16


def added_lines(patch: Column) -> Column:
    """Distinct added lines of a patch, white space squeezed; blank lines and file headers are none."""
    own = F.filter(F.split(patch, r"\r\n|\n|\r"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_distinct(F.filter(F.transform(own, lambda x: squeeze(F.substring(x, 2, 2**31 - 1))), lambda x: x != ""))


def finding_paths(affected: Column, evidence: Column) -> Column:
    """Affected paths, then those of the evidence, each once, without blank ones."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(affected, none), F.coalesce(F.transform(evidence, lambda e: e["path"]), none))
    return F.array_distinct(F.filter(both, lambda p: p.isNotNull() & p.rlike(r"\S")))


def cited(evidence: Column) -> Column:
    """Squeezed quotes of the evidence on the commit itself."""
    own = F.filter(evidence, lambda e: F.coalesce(e["revision"], F.lit("commit")) == "commit")
    return F.array_distinct(F.filter(F.transform(own, lambda e: squeeze(F.coalesce(e["quoted_span"], F.lit("")))), lambda q: q != ""))


def merges_of(commits: DataFrame, shas: DataFrame) -> DataFrame:
    return shas.join(commits.where(F.size("parents") > 1), "sha").select(F.col("sha").alias("merge"), F.element_at("parents", 1).alias("first_parent"))


def history(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return commits.select(F.col("sha").alias("child"), F.posexplode("parents").alias("k", "parent")), commits.select(F.col("sha").alias("node"), "place")


def attribute(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """findings with attributed and method: where the finding belongs, and why.

    direct: no merge. merge_first_parent_walk: the one commit brought in that touches the paths. merge_evidence_content: of several, the
    one that added a cited line. ambiguous: several did, or none. declined: the merge brings in over MOST commits. unchanged: it brings
    in none, or none touches the paths, or the finding has no path, or its commit is not known.
    """
    edges, order = history(commits)
    brought = reach.brought_in(edges, merges_of(commits, findings.select("sha").distinct()), order, MOST)
    facts = commits.select(F.col("sha").alias("_sha"), (F.size("parents") > 1).alias("_merge"))
    own = findings.withColumn("_paths", finding_paths(F.col("affected_paths"), F.col("evidence"))).withColumn("_cited", cited(F.col("evidence")))
    side = commits.select(F.col("sha").alias("node"), F.col("paths").alias("_touched"), "added")
    pairs = own.select("seq", "sha", "_paths", "_cited").join(brought, F.col("sha") == F.col("merge")).join(side, "node", "left")
    touches = F.coalesce(F.arrays_overlap("_paths", "_touched"), F.lit(False))
    adds = touches & F.arrays_overlap("_cited", "added")
    one = lambda c: F.min(F.when(c, F.col("node")))
    found = pairs.groupBy(F.col("seq").alias("_seq")).agg(
        F.count_if(F.col("node").isNull()).alias("_over"), F.count_if(touches).alias("_n"), one(touches).alias("_only"), F.count_if(adds).alias("_k"), one(adds).alias("_adds"),
    )
    out = own.join(facts, F.col("sha") == F.col("_sha"), "left").join(found, F.col("seq") == F.col("_seq"), "left")
    method = (
        F.when(F.col("_merge").isNull(), "unchanged").when(~F.col("_merge"), "direct").when(F.col("_n").isNull(), "unchanged").when(F.col("_over") > 0, "declined")
        .when(F.size("_paths") == 0, "unchanged").when(F.col("_n") == 1, "merge_first_parent_walk").when(F.col("_n") == 0, "unchanged").when(F.col("_k") == 1, "merge_evidence_content").otherwise("ambiguous")
    )
    to = F.when(method == "merge_first_parent_walk", F.col("_only")).when(method == "merge_evidence_content", F.col("_adds")).otherwise(F.col("sha"))
    return out.select(*findings.columns, to.alias("attributed"), method.alias("method"))


def rebase(moved: DataFrame, commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """moved findings (with attributed) with evidence at the new commit and rebased: whether every quote still stands there.

    Evidence on the commit goes to the new one, on the parent to the new one's first parent, and on the head stays as it is.
    """
    parents = commits.select(F.col("sha").alias("_sha"), F.try_element_at("parents", F.lit(1)).alias("_parent"))
    kind = F.coalesce(F.col("e.revision"), F.lit("commit"))
    to = F.when(kind == "commit", F.col("attributed")).when(kind == "parent", F.col("_parent"))
    files = blobs.select(F.col("sha").alias("_at"), F.col("path").alias("_file"), "content")
    each = moved.join(parents, F.col("attributed") == F.col("_sha"), "left").select("seq", "attributed", "_parent", F.posexplode("evidence").alias("k", "e")).withColumn("to", to)
    each = each.join(files, (F.col("to") == F.col("_at")) & (F.col("e.path") == F.col("_file")), "left")
    first = F.greatest(F.col("e.start_line"), F.lit(1)).cast("int")
    read = F.slice(F.split("content", "\n"), first, F.greatest(F.col("e.end_line").cast("int") - first + 1, F.lit(0)))
    quote = squeeze(F.coalesce(F.col("e.quoted_span"), F.lit("")))
    stands = (quote != "") & squeeze(F.array_join(read, "\n")).contains(quote)
    head = ~kind.isin("commit", "parent")
    new = F.when(head, F.col("e")).otherwise(F.col("e").withField("revision_sha", F.col("to")))
    sums = each.groupBy(F.col("seq").alias("_seq")).agg(F.bool_and(head | F.coalesce(stands, F.lit(False))).alias("_ok"), F.sort_array(F.collect_list(F.struct("k", new.alias("e")))).alias("_new"))
    out = moved.join(sums, F.col("seq") == F.col("_seq"), "left")
    ok = F.coalesce("_ok", F.lit(True))
    evidence = F.when(ok, F.coalesce(F.transform("_new", lambda x: x["e"]), F.col("evidence"))).otherwise(F.col("evidence"))
    return out.select(*[evidence.alias(c) if c == "evidence" else F.col(c) for c in moved.columns], ok.alias("rebased"))


def deduplicate(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of findings (seq, sha, patch_id, evidence, attributed_from): of equal patches the finding of most evidence stays,
    then one that was not moved, then the smaller sha, in the place of the first of them. Without a patch id all stay.

    dropped: (sha, attributed_from, duplicate_of, patch_id); duplicate_of is the best one when the loser was met or beaten. shas are
    lower-case hex.
    """
    turned = F.translate("sha", "0123456789abcdef", "fedcba9876543210")  # the smaller the greater
    rank = F.struct(F.size(F.coalesce("evidence", F.array().cast(findings.schema["evidence"].dataType))).alias("n"), F.col("attributed_from").isNull().alias("still"), turned.alias("t"))
    rows = findings.where(F.coalesce("patch_id", F.lit("")) != "").withColumn("_rank", rank)
    before = Window.partitionBy("patch_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("patch_id")
    best = lambda w: F.max(F.struct("_rank", (-F.col("seq")).alias("s"), F.struct("sha", "attributed_from").alias("f"))).over(w)
    rows = rows.withColumn("_was", best(before)).withColumn("_best", best(all_)).withColumn("_slot", F.min("seq").over(all_))
    kept = rows.where(-F.col("_best.s") == F.col("seq")).withColumn("seq", F.col("_slot")).drop("_rank", "_was", "_best", "_slot")
    free = findings.where(F.coalesce("patch_id", F.lit("")) == "")
    wins = F.col("_rank") > F.col("_was._rank")
    lost = F.when(wins, F.col("_was.f")).otherwise(F.struct("sha", "attributed_from"))
    dropped = rows.where("_was IS NOT NULL").select(lost["sha"].alias("sha"), lost["attributed_from"].alias("attributed_from"), F.when(wins, F.col("sha")).otherwise(F.col("_was.f.sha")).alias("duplicate_of"), "patch_id")
    return free.unionByName(kept), dropped


def collapse(findings: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a finding on a merge goes where a finding on a commit that the merge brought in shares a path with it, or it has
    no path; the first such commit takes it. dropped is as in deduplicate(), with an empty patch id."""
    edges, order = history(commits)
    own = findings.withColumn("_paths", finding_paths(F.col("affected_paths"), F.col("evidence")))
    per = Window.partitionBy("sha").orderBy(F.col("seq").desc())
    one = own.withColumn("_first", F.min("seq").over(Window.partitionBy("sha"))).withColumn("_rn", F.row_number().over(per)).where("_rn = 1")
    one = one.select("sha", "attributed_from", "_paths", "_first")
    brought = reach.brought_in(edges, merges_of(commits, one.select("sha")), order, None)
    child = one.select(F.col("sha").alias("node"), F.col("_paths").alias("_theirs"), F.col("_first").alias("_at"))
    pairs = own.select("sha", "_paths").join(brought, F.col("sha") == F.col("merge")).join(child, "node").where((F.size("_paths") == 0) | F.arrays_overlap("_paths", "_theirs"))
    gone = pairs.groupBy("sha").agg(F.min_by("node", "_at").alias("duplicate_of"))
    dropped = one.join(gone, "sha").select("sha", "attributed_from", "duplicate_of", F.lit("").alias("patch_id"))
    return findings.join(gone.select("sha"), "sha", "left_anti").select(*findings.columns), dropped


def apply(findings: DataFrame, commits: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, moves, duplicates): attribute, check the evidence at the new place, and only then fold duplicates.

    A finding whose quotes don't stand at the new commit stays, as declined_anchor_mismatch. moves: (sha, original_sha, method).
    """
    placed = attribute(findings, commits)
    away = F.col("attributed") != F.col("sha")
    moved = rebase(placed.where(away), commits, blobs)
    gone = moved.where("rebased").withColumn("attributed_from", F.col("sha")).withColumn("sha", F.col("attributed"))
    none = F.lit(None).cast("string")
    stayed = moved.where("NOT rebased").withColumn("method", F.lit("declined_anchor_mismatch")).withColumn("attributed_from", none)
    columns = [*findings.columns, "method", "attributed_from"]
    rows = placed.where(~away).withColumn("attributed_from", none).select(columns).unionByName(stayed.select(columns)).unionByName(gone.select(columns))
    rows = graph.cut(rows.join(commits.select("sha", "patch_id"), "sha", "left").select(*columns, "patch_id"))
    kept, twice = deduplicate(rows)
    kept, folded = collapse(kept, commits)
    return kept, gone.select("sha", F.col("attributed_from").alias("original_sha"), "method"), twice.unionByName(folded)


def introduction_span(fixed: str, introduced: str, is_root: str):
    """Whole days from introduction to fix, rounded down, and why there are none: no commit, the root, no time, negative."""
    days = F.floor((F.unix_timestamp(fixed) - F.unix_timestamp(introduced)) / 86400)
    why = F.when(F.col(is_root).isNull(), "declined_no_commit").when(F.col(is_root), "declined_genesis").when(days.isNull(), "declined_no_date").when(days < 0, "declined_negative").otherwise("blame")
    return F.when(why == "blame", days).alias("days"), why.alias("method")


def parent_anchors(evidence: Column) -> Column:
    """Evidence on the parent revision whose path and line range are usable."""
    return F.filter(evidence, lambda e: (e["revision"] == "parent") & e["path"].isNotNull() & (e["path"] != "") & (e["start_line"] >= 1) & (e["end_line"] >= e["start_line"]))


def blame_runs(blame: DataFrame, keys: tuple[str, ...] = ("sha", "path")) -> DataFrame:
    """(sha, path, first, last, commit): runs of lines that one commit last touched, from (sha, path, line, commit); keys name a file.

    Only first and last lines of runs go on, in the order that they have, so nothing but that one sort is held.
    """
    file = Window.partitionBy(*keys).orderBy("line")
    goes_on = lambda step, by: F.coalesce(step("commit").over(file).eqNullSafe(F.col("commit")) & (step("line").over(file) == F.col("line") + by), F.lit(False))
    ends = blame.select(*keys, "line", "commit", (~goes_on(F.lag, -1)).alias("_starts"), (~goes_on(F.lead, 1)).alias("_ends")).where("_starts OR _ends")
    runs = ends.withColumn("last", F.when(F.col("_ends"), F.col("line")).otherwise(F.lead("line").over(file))).where("_starts")
    return runs.select(*keys, "commit", F.col("line").alias("first"), "last")


def ranges(anchors: Column) -> Column:
    """The anchors as (sha, path, lo, -hi), in order."""
    return F.sort_array(F.transform(anchors, lambda e: F.struct(e["revision_sha"].alias("sha"), e["path"].alias("path"), e["start_line"].alias("lo"), (-e["end_line"]).alias("back"))))


def not_held(x: Column) -> Column:
    """Ranges in order, without those that the one before them holds."""
    held = lambda b, a: (a["sha"] == b["sha"]) & (a["path"] == b["path"]) & (a["back"] <= b["back"])
    return F.filter(x, lambda b, k: F.when(k == 0, True).otherwise(~F.coalesce(held(b, F.get(x, k - 1)), F.lit(False))))


def block_of(line: str) -> Column:
    return F.floor(F.col(line) / BLAME_BLOCK)


def blocks_of(lo: str, hi: str) -> Column:
    """Blocks of BLAME_BLOCK lines that a range of lines lies in."""
    return F.explode(F.sequence(block_of(lo), block_of(hi))).alias("_block")


def cut_to(asked: DataFrame, end: Column) -> DataFrame:
    """Ranges without what is behind the last line."""
    return asked.where(F.col("lo") <= end).withColumn("hi", F.least("hi", end))


def oldest_introduction(findings: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """(seq, introduced_by, introduced_at, is_root): the oldest commit, by committer time, that last touched a line of a finding's parent
    evidence, of ranges however long; lines that a file doesn't have count as none. blame: (sha, path, first, last, commit), or a row a
    line as for blame_runs(); commits: (sha, committed_at, parents).

    Ranges and runs meet in blocks of lines, so a large file is dealt to many tasks and no row a line is made; rows a line are made to runs
    inside their blocks, where they meet the ranges, so they are shuffled once. Only runs that a range meets look for their commits, and
    the oldest commit of a finding is a minimum that tasks take before anything is shuffled. Of equal times the smaller commit counts.

    A range over more than BLAME_FAR blocks of its file meets runs in its first and last block only. The blocks between are asked for
    their own oldest commit, each once however many ranges hold it.
    """
    asked = findings.select("seq", ranges(parent_anchors(F.col("evidence"))).alias("_x")).select("seq", F.explode(not_held(F.col("_x"))).alias("e")).select("seq", "e.sha", "e.path", "e.lo", (-F.col("e.back")).alias("hi"))
    last = F.max("line" if "line" in blame.columns else "last").alias("_end")
    size = blame.agg(F.count("*").alias("n"), last).first()
    asked = cut_to(asked, F.lit(size["_end"]))
    # both joins are dealt by rows, as tasks cut by compressed bytes would hold too many of them
    parts = max(int(blame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // BLAME_ROWS))
    spot = F.concat("sha", F.lit("\0"), "path", F.lit("\0"), F.col("_block").cast("string")).alias("_spot")  # no sha or path holds a NUL
    if "line" in blame.columns:
        lines = blame.withColumn("_block", block_of("line")).select(spot, "line", "commit")
        runs = blame_runs(lines.repartition(parts, "_spot"), ("_spot",))
    else:
        runs = blame.select("sha", "path", "first", "last", "commit", blocks_of("first", "last")).select(spot, "first", "last", "commit").repartition(parts, "_spot")
    far = block_of("hi") - block_of("lo") >= BLAME_FAR
    whole = None
    if not asked.where(far).isEmpty():
        cuts = graph.cut(cut_to(asked.where(far).join(blame.groupBy("sha", "path").agg(last), ["sha", "path"]), F.col("_end")).select(asked.columns))
        long = cuts.where(far)
        ends = F.array(F.struct("lo", ((block_of("lo") + 1) * BLAME_BLOCK - 1).cast("int").alias("hi")), F.struct((block_of("hi") * BLAME_BLOCK).cast("int").alias("lo"), "hi"))
        edges = long.select("seq", "sha", "path", F.explode(ends).alias("r")).select("seq", "sha", "path", "r.lo", "r.hi")
        asked = asked.where(~far).unionByName(cuts.where(~far)).unionByName(edges)
        whole = long.select("*", F.explode(F.sequence(block_of("lo") + 1, block_of("hi") - 1)).alias("_block")).select("seq", spot)
    asked = asked.select("*", blocks_of("lo", "hi")).select("seq", F.lit(None).cast("string").alias("_whole"), spot, "lo", "hi")
    key = ["seq"]
    if whole is not None:
        key.append("_whole")
        asked = asked.unionByName(whole.select("_spot").distinct().select(F.lit(None).alias("seq"), F.col("_spot").alias("_whole"), "_spot", F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi")))
    met = asked.repartition(parts, "_spot").join(runs, "_spot").where((F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("lo"))).select(*key, "commit")
    known = commits.select(F.col("sha").alias("commit"), "committed_at", (F.size("parents") == 0).alias("root"))
    hit = met.repartition(parts, "commit").join(known.repartition(parts, "commit"), "commit")
    first = hit.groupBy(*key).agg(F.min(F.when(F.col("committed_at").isNotNull(), F.struct("committed_at", "commit", "root"))).alias("o"))
    if whole is not None:
        first = graph.cut(first)
        blocks = first.where("_whole IS NOT NULL").select(F.col("_whole").alias("_spot"), "o")
        first = first.where("_whole IS NULL").select("seq", "o").unionByName(whole.join(blocks, "_spot").select("seq", "o")).groupBy("seq").agg(F.min("o").alias("o"))
    return first.select("seq", F.col("o.commit").alias("introduced_by"), F.col("o.committed_at").alias("introduced_at"), F.col("o.root").alias("is_root"))
