"""What a reviewer of a change is shown: first-party sections, input profiles and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospector.functions import diffs, text

# Bytes of an input, a subject and a message at most; kinds of changes in the order in which they are listed; errors.
INPUT_BYTES, SUBJECT_BYTES, MESSAGE_BYTES = 110_000, 512, 8_192
KINDS = ("source", "test", "docs", "dependency", "generated_vendor", "binary", "submodule", "merge_resolution", "other")
ERRORS = {
    "empty": "raw diff is empty",
    "empty_first_party": "no first-party files remain after generated/vendor filtering",
    "malformed": "input is not a recognizable Git diff",
}
PROFILES = ("D0", "D1", "D2", "D3")


def blank(x: Column) -> Column:
    return ~x.rlike(r"\S")


def normal_section(section: Column) -> Column:
    """A file section with line feeds only, without its index line, ending in a line feed."""
    out = F.regexp_replace(text.normalize_newlines(section), r"(?m)^index [0-9a-fA-F]+\.\.[0-9a-fA-F]+(?: [0-9]+)?(?:\n|\z)", "")
    return F.when((out == "") | out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as shuffles have, since a small file of many rows is one task, however long each row takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_party(df: DataFrame, diff: str) -> DataFrame:
    """df with body, files, excluded_paths, change_kinds, raw_diff_hash, normalized_diff_hash and status of its diffs.

    files: (old_path, new_path, path, text, kind, reason) of each section; those with a reason are generated or vendored and left out
    of body. status: ready, empty, malformed (no section), empty_first_party (nothing left). Null diffs: empty.
    """
    raw = F.coalesce(F.col(diff), F.lit(""))
    out = dealt(df).withColumn("_sections", F.transform(text.file_sections(raw), normal_section))
    out = out.withColumn("_names", diffs.section_names(F.col("_sections")))
    file = lambda s, n: F.struct(
        n["old_path"].alias("old_path"), n["new_path"].alias("new_path"), n["path"].alias("path"), s.alias("text"),
        text.change_kind(n["path"], s).alias("kind"), text.generated_reason(n["path"], s).alias("reason"),
    )
    out = out.withColumn("files", F.zip_with("_sections", "_names", file)).drop("_sections", "_names")
    kept = F.filter("files", lambda f: f["reason"].isNull())
    out = out.withColumn("body", F.array_join(F.transform(kept, lambda f: f["text"]), ""))
    present = F.transform("files", lambda f: f["kind"])
    status = F.when(blank(raw), "empty").when(F.size("files") == 0, "malformed").when(blank(F.col("body")), "empty_first_party").otherwise("ready")
    return out.withColumns({
        "excluded_paths": F.array_sort(F.transform(F.filter("files", lambda f: f["reason"].isNotNull()), lambda f: f["path"])),
        "change_kinds": F.filter(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.array_contains(present, k)),
        "raw_diff_hash": text.content_hash(raw), "normalized_diff_hash": text.content_hash(F.col("body")), "status": status,
    })


def prefix(profile: str, subject: Column, message: Column, subject_bytes: int = SUBJECT_BYTES, message_bytes: int = MESSAGE_BYTES) -> Column:
    """What stands before the diff: nothing, the subject's first line (D2), or the message (D3)."""
    shown = {"D2": ("### Commit subject\n", F.substring_index(text.normalize_newlines(F.coalesce(subject, F.lit(""))), "\n", 1), subject_bytes), "D3": ("### Commit message\n", text.normalize_newlines(F.coalesce(message, F.lit(""))), message_bytes)}
    if profile not in shown:
        return F.lit("")
    head, said, most = shown[profile]
    said = diffs.stripped(said)
    return F.concat(F.lit(head), diffs.cap(F.when(said == "", "(empty)").otherwise(said), most), F.lit("\n\n### Diff\n"))


def input_profile(df: DataFrame, profile: str, diff: str, subject: Column | None = None, message: Column | None = None, most: int = INPUT_BYTES) -> DataFrame:
    """df with the input of a profile: D0 the raw diff, D1 its first-party sections, D2 these after the subject, D3 after the message.

    Adds the columns of first_party(), text, input_hash, chunks (number, text, bytes, sha256, paths), status and error. Only ready inputs
    have chunks; a prefix that fills the budget makes an input oversize.
    """
    if profile not in PROFILES:
        raise ValueError("profile must be D0, D1, D2, or D3")
    out = first_party(df, diff)
    if profile == "D0":
        raw = F.coalesce(F.col(diff), F.lit(""))
        ready = raw.rlike(r"(?:\A|(?<=\n))diff --(?:git|cc|combined) ")
        out = out.withColumn("body", raw).withColumn("status", F.when(blank(raw), "empty").when(ready, "ready").otherwise("malformed"))
    before = prefix(profile, F.lit("") if subject is None else subject, F.lit("") if message is None else message)
    out = out.withColumn("_before", before).withColumn("text", F.concat("_before", "body")).withColumn("input_hash", text.content_hash(F.col("text")))
    ready = F.col("status") == "ready"
    out = out.withColumn("_cut", diffs.chunk(F.when(ready, F.col("body")), most, F.when(ready, F.col("_before")).otherwise("")))
    over = ready & F.col("_cut.error").isNotNull()
    known = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    out = out.withColumn("chunks", F.col("_cut.chunks")).withColumn("error", F.when(over, F.col("_cut.error")).otherwise(F.try_element_at(known, F.col("status"))))
    return out.withColumn("status", F.when(over, "oversize").otherwise(F.col("status"))).drop("_cut", "_before")


def input_hashes(profiled: DataFrame) -> DataFrame:
    """The four hashes of an input: of the raw diff, of what is left of it, of the text, and of each chunk."""
    return profiled.withColumn("hashes", F.struct("raw_diff_hash", "normalized_diff_hash", "input_hash", F.transform("chunks", lambda c: c["sha256"]).alias("chunk_hashes")))


def matches_input(decision: Column, profiled: Column) -> Column:
    """A decision was made on this very input: (profile, raw_diff_hash, normalized_diff_hash, chunk_hashes) of both are equal."""
    keys = ("profile", "raw_diff_hash", "normalized_diff_hash", "chunk_hashes")
    return F.struct(*[decision[k].alias(k) for k in keys]) == F.struct(*[profiled[k].alias(k) for k in keys])
