"""Substring dedup: windows of words counted exactly in buckets of super-k-mers."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.llm.common import cut, sorted_groups, table

#: Words of a window, and of the pieces whose least hash is a window's minimiser.
WINDOW, PIECE = 13, 3
#: Windows that one super-k-mer holds at most.
RUN = 32
#: Text bytes whose super-k-mers are gathered before they are sent, text bytes hashed at once, and text bytes a bucket stands for.
GATHER, HASHED, BUCKET = 6 << 20, 1 << 20, 2 << 20
#: Postings expanded to windows at a time in a bucket.
EXPAND = 50_000

ODD = np.uint64(0x9E3779B97F4A7C15)


def inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch [start, end) of a byte buffer; stretches are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(starts, starts[k] + HASHED)))
        lo, hi = int(starts[k]), int(ends[m - 1])
        at = np.arange(hi - lo, dtype=np.int64)
        owner = np.searchsorted(starts[k:m] - lo, at, side="right") - 1
        offset = at - (starts[k:m] - lo)[owner]
        table_ = powers(int(ODD), int(offset.max()) + 1)
        value = (arr[lo:hi].astype(np.uint64) + np.uint64(1)) * table_[offset]
        value[at >= (ends[k:m] - lo)[owner]] = 0
        out[k:m] = np.add.reduceat(value, starts[k:m] - lo)
        k = m
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def spans(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends of a buffer of lines of words, each word followed by a space or a line break, and each word's line."""
    ends = np.flatnonzero((arr == 32) | (arr == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    line = np.concatenate(([0], np.cumsum(arr[ends] == 10)[:-1]))
    return starts, ends, line


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by doubling."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def super_kmers(buffer: bytes, arr: np.ndarray):
    """(line, first word in the line, minimiser, string) of each run of windows that share a minimiser."""
    starts, ends, line = spans(arr)
    n = len(starts)
    if n < WINDOW:
        return
    h = word_hashes(arr, starts, ends)
    pieces = h[: n - PIECE + 1].copy()
    for k in range(1, PIECE):
        pieces = pieces * np.uint64(0xD1342543DE82EF95) + h[k : n - PIECE + 1 + k]
    pieces ^= pieces >> np.uint64(31)
    pieces *= np.uint64(0x94D049BB133111EB)
    pieces ^= pieces >> np.uint64(29)
    low = least(pieces, WINDOW - PIECE + 1)
    count = n - WINDOW + 1
    whole = line[:count] == line[WINDOW - 1 :]
    new = np.ones(count, bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1] | ~whole[1:] | (line[1:count] != line[: count - 1])
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, count))
    if (lengths > RUN).any():  # long runs of one minimiser are cut
        extra = [np.arange(a, a + k, RUN) for a, k in zip(at[lengths > RUN], lengths[lengths > RUN], strict=True)]
        at = np.unique(np.concatenate([at, *extra]))
        lengths = np.diff(np.append(at, count))
    keep = whole[at]
    at, lengths = at[keep], lengths[keep]
    first = np.searchsorted(line, line[at])
    for ln, pos, m, a, z in zip(line[at].tolist(), (at - first).tolist(), low[at].tolist(), starts[at].tolist(), ends[at + lengths + WINDOW - 2].tolist(), strict=True):
        yield ln, pos, m, buffer[a:z]


def pack(found: dict[bytes, list]) -> bytes:
    """One bucket's strings, each with its postings (doc_id, key, position), compressed."""
    postings = [p for ps in found.values() for p in ps]
    parts = [
        b"\n".join(found) + b"\n",
        np.array([len(ps) for ps in found.values()], np.int32).tobytes(),
        np.array([p[0] for p in postings], np.int64).tobytes(),
        np.array([p[1] for p in postings], np.uint64).tobytes(),
        np.array([p[2] for p in postings], np.int32).tobytes(),
    ]
    head = np.array([len(x) for x in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(blob: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw[:40], np.int64).tolist()
    at, parts = 40, []
    for size, kind in zip(sizes, (None, np.int32, np.int64, np.uint64, np.int32), strict=True):
        part = raw[at : at + size]
        parts.append(part if kind is None else np.frombuffer(part, kind))
        at += size
    return tuple(parts)


def repeated(buffer: bytes, counts: np.ndarray, ids: np.ndarray):
    """For strings with postings: per window, its string and the smallest id that any equal window of the bucket has.

    Windows are sorted by a hash of their words; neighbours of one hash are compared byte by byte, so equality is exact.
    Returns (string of each window, offset in it, smallest id).
    """
    arr = np.frombuffer(buffer, np.uint8)
    starts, ends, line = spans(arr)
    n = len(starts)
    posting = np.concatenate(([0], np.cumsum(counts)[:-1]))
    mine = np.minimum.reduceat(ids, posting)
    h = word_hashes(arr, starts, ends)
    q = 0xD6E8FEB86659FD93
    rolled = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(q, n), dtype=np.uint64)))
    count = n - WINDOW + 1
    at = np.flatnonzero(line[:count] == line[WINDOW - 1 :])
    value = (rolled[at + WINDOW] - rolled[at]) * powers(inverse(q), count)[at]
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    a, z = starts[at], ends[at + WINDOW - 1]
    same = np.zeros(len(at), bool)
    same[1:] = value[1:] == value[:-1]
    for k in np.flatnonzero(same).tolist():
        if buffer[a[k - 1] : z[k - 1]] != buffer[a[k] : z[k]]:  # two texts of one hash: sort this run by its bytes
            lo = k - 1
            while same[lo]:
                lo -= 1
            hi = k + 1
            while hi < len(same) and same[hi]:
                hi += 1
            run = sorted(range(lo, hi), key=lambda j: buffer[a[j] : z[j]])
            at[lo:hi], a[lo:hi], z[lo:hi] = at[run], a[run], z[run]
            for j in range(lo + 1, hi):
                same[j] = buffer[a[j - 1] : z[j - 1]] == buffer[a[j] : z[j]]
    group = np.cumsum(~same) - 1
    low = np.minimum.reduceat(mine[line[at]], np.flatnonzero(~same))[group]
    back = np.argsort(at, kind="stable")
    at, low = at[back], low[back]
    first = np.searchsorted(line, np.arange(len(counts)))
    return line[at], at - first[line[at]], low


def covered(buffer: bytes, counts, ids, keys, pos):
    """Stretches (id, key, first word, after last word) covered by windows that also start in a document of a smaller id."""
    string, offset, low = repeated(buffer, counts, ids)
    begin = np.searchsorted(string, np.arange(len(counts)))
    width = np.bincount(string, minlength=len(counts))
    owner = np.repeat(np.arange(len(counts)), counts)
    least_low = np.minimum.reduceat(low, begin)
    wanted = np.flatnonzero(ids > least_low[owner])
    for k in range(0, len(wanted), EXPAND):
        p = wanted[k : k + EXPAND]
        s = owner[p]
        w = width[s]
        which = np.repeat(np.arange(len(p)), w)
        at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        hit = low[begin[s][which] + at] < ids[p][which]
        which, at = which[hit], at[hit]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)
        last = np.append(new[1:], True)
        p0 = p[which[new]]
        yield ids[p0], keys[p0].view(np.int64), (pos[p0] + at[new]).astype(np.int32), (pos[p0] + at[last] + WINDOW).astype(np.int32)


def text_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def intervals(docs: DataFrame, keyed: bool, buckets: int) -> DataFrame:
    """Rows (doc_id, key, first, after) of stretches to remove; key tells apart the texts of a repeated doc_id if keyed, else it is 0."""

    def send(batches):
        found: dict[int, dict[bytes, list]] = defaultdict(dict)
        lines: list[tuple] = []
        pieces: list[bytes] = []
        held = size = 0

        def work():
            buffer = b"".join(pieces)
            for ln, pos, m, s in super_kmers(buffer, np.frombuffer(buffer, np.uint8)):
                doc_id, key, shift = lines[ln]
                found[(m >> 20) % buckets].setdefault(s, []).append((doc_id, key, pos + shift))
            lines.clear()
            pieces.clear()

        def flush():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([pack(x) for x in found.values()], pa.binary())], names=["bucket", "blob"])
                found.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if doc_id is None or len(words) < WINDOW:
                    continue
                key = text_key(words) if keyed else 0
                step = 20_000  # long texts go on in lines that overlap by all but one word of a window
                for k in range(0, len(words) - WINDOW + 1, step):
                    part = b" ".join(words[k : k + step + WINDOW - 1]) + b"\n"
                    lines.append((doc_id, key, k))
                    pieces.append(part)
                    held, size = held + len(part), size + len(part)
                    if held >= HASHED:
                        work()
                        held = 0
                    if size >= GATHER:
                        work()
                        yield from flush()
                        size = 0
        work()
        yield from flush()

    def answer(batches):
        for _, t in sorted_groups(batches, 1):
            parts = [unpack(x) for x in t.column(1).to_pylist()]
            buffer = b"".join(x[0] for x in parts)
            arrays = [np.concatenate([x[k] for x in parts]) for k in range(1, 5)]
            for ids, keys, first, after in covered(buffer, *arrays):
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(first), pa.array(after)], names=["doc_id", "key", "first", "after"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(send, "bucket long, blob binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc_id long, key long, first int, after int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for every row.

    A word goes if one of the 13-word windows over it also starts in a document of a smaller id; all windows are judged on the input.
    Super-k-mers of a batch of documents are merged before they travel: a passage that many documents share is sent once a batch, with
    its places. Null text: no words. Fewer than 13 words: kept whole. Null id: neither keeps nor loses anything. Rows of one id have
    none smaller among themselves; rows repeated whole are treated alike. Bytes that are no UTF-8 are compared and hashed as they are;
    kept_text shows them as U+FFFD. Other columns are not looked at. No rows: none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    keyed = bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = cut(intervals(rows, keyed, max(1, size // BUCKET)))
    per_doc = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "after")).alias("gone"))
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files that the line before has done with

    def shrink(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            keys, packed = [], []
            for t in b.column(1).to_pylist():
                words = (t or b"").split()
                keys.append(np.uint64(text_key(words)).astype(np.int64) if keyed else 0)
                packed.append(press.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])

    def keep(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            ids, texts, gone = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[list] = [[], [], [], []]
            for packed, stretches in zip(texts, gone, strict=True):
                raw = press.decompress(packed)
                words = raw.split()
                n = len(words)
                if stretches:
                    mask = np.zeros(n + 1, np.int64)
                    np.add.at(mask, [s["first"] for s in stretches], 1)
                    np.add.at(mask, [s["after"] for s in stretches], -1)
                    raw = b" ".join([words[k] for k in np.flatnonzero(np.cumsum(mask)[:n] == 0).tolist()])
                for x, value in zip(out, (n, n - (raw.count(b" ") + 1 if raw else 0), raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()), strict=True):
                    x.append(value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    small = rows.mapInArrow(shrink, "doc_id long, key long, packed binary")
    joined = small.join(per_doc, ["doc_id", "key"], "left").select("doc_id", "packed", "gone")
    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op1(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
