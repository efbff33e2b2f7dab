"""Line dedup by an exact set-similarity join; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospector.llm.common import cut, drop, release, stored, table

#: Two sets of n and m words have a Jaccard similarity of 4/5 or more if SHARE[1] * (words they share) >= SHARE[0] * (n + m).
SHARE = (4, 9)
#: Bits of a word's hash that name the class in which it is counted for the rarity order, and bits of it that break ties.
CLASS_BITS, TIE_BITS = 17, 46
#: Columns that hold a line's parities; lines of more words than FINE carry more of them.
PARITIES, FINE = ("parity", "bit6", "bit7", "both"), (96, 192)
#: Longs of 64 parity bits by which candidates are compared before their texts are.
PARITY = 4
#: Bits of a word's place in the order that travel, and of its predecessor's.
WORD_BITS, BEFORE_BITS = (1 << 40) - 1, (1 << 48) - 1
#: The first round looks at one in so many prefix words, by hash; the second at all.
EVERY = 4
#: Other lines that a line of the second round is looked at with one by one, before all the rest at once.
NEAREST = 1
#: Rows of line ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
HAS_WORDS = r"[^\x20\x09-\x0D]"


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def pieces(line: Column) -> Column:
    """A line's words in order, with empty strings where white space meets; single blanks split without a regular expression."""
    plain = F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.split(plain, " ")


def words(line: Column) -> Column:
    """Distinct words of a line."""
    return F.array_distinct(F.array_remove(pieces(line), ""))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of every line of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def identity(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("lid"), F.xxhash64(F.lit(1), line).alias("lid2")]


def rarity(lines: DataFrame) -> Column:
    """The place of each hash class of words by how often its words occur in all lines, above TIE_BITS bits, as a constant array."""
    word_class = F.shiftrightunsigned(F.xxhash64("w"), 64 - CLASS_BITS).cast("int")
    counted = lines.select(F.explode(pieces(F.col("line"))).alias("w")).groupBy(word_class.alias("b")).count().collect()  # 2 ** CLASS_BITS rows at most
    place = ["0"] * (1 << CLASS_BITS)
    for k, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["b"]))):
        place[r["b"]] = str(k << TIE_BITS)
    return F.split(F.lit(",".join(place)), ",").cast("array<long>")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """First occurrence (doc_id, line_no) of each distinct line that has words, with its prefix of rarest words; no line's text travels.

    Words are ordered by how often their hash class occurs, then by hash, so the order is the same everywhere. `parity` has a bit for
    each of 64 hash classes of words, set if the class holds an odd number of the line's words: it differs in no more bits than the
    word sets differ in words. Longer lines also carry what the words with one bit of their hash set (bit6), with another (bit7) and
    with both make of that, which gives the parities of 128 or 256 classes; see differing().
    """
    places = rarity(lines)
    hashed = F.array_distinct(F.transform(F.array_remove(pieces(F.col("line")), ""), lambda x: F.xxhash64(x)))
    # never null, and Spark is told so: then it sorts plain numbers
    order = lambda h: F.coalesce(F.get(places, F.shiftrightunsigned(h, 64 - CLASS_BITS).cast("int")), F.lit(0).cast("long"))
    keyed = F.sort_array(F.transform(hashed, lambda h: order(h).bitwiseOR(h.bitwiseAND(F.lit((1 << TIE_BITS) - 1)))))
    usable = F.col("doc_id").isNotNull() & F.col("line").rlike(HAS_WORDS)
    out = lines.where(usable).select(*identity(F.col("line")), "doc_id", "line_no", keyed.alias("k"))
    n = F.size("k")
    place = lambda h: h.bitwiseAND(63).cast("int")
    at = lambda h, bit: F.shiftright(h, bit)

    def parity(value) -> Column:
        return F.aggregate("k", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", value(h), place(h))))

    one = F.lit(1).cast("long")
    finer = [
        F.when(n > FINE[0], parity(lambda h: at(h, 6).bitwiseAND(one))),
        F.when(n > FINE[1], parity(lambda h: at(h, 7).bitwiseAND(one))),
        F.when(n > FINE[1], parity(lambda h: at(h, 7).bitwiseAND(at(h, 6)).bitwiseAND(one))),
    ]
    least = F.ceil(n * (SHARE[0] / (SHARE[1] - SHARE[0])) - 1e-9)  # words that a similar set shares at least
    prefix = F.slice("k", 1, F.greatest(n - least + 1, F.lit(1)).cast("int"))
    out = out.select("lid", "lid2", "doc_id", "line_no", n.alias("n"), parity(lambda h: one).alias("parity"), *[x.alias(p) for p, x in zip(PARITIES[1:], finer, strict=True)], prefix.alias("prefix"))
    w = Window.partitionBy("lid", "lid2").orderBy("doc_id", "line_no")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")  # limits rows before the shuffle too


def parities(of: Column) -> list[Column]:
    """PARITY columns of 64 bits: a bit for each hash class of words, set if the class holds an odd number of the words.

    Two sets differ in no more bits than in words.
    """
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    part = lambda h: F.pmod(F.shiftright(h, 6), F.lit(PARITY))
    hashes = F.transform(of, lambda w: F.xxhash64(w))

    def parity(q: int) -> Column:
        return F.aggregate(F.filter(hashes, lambda h: part(h) == q), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))

    return [parity(q).alias(f"p{q}") for q in range(PARITY)]


def differing(left, right) -> Column:
    """Bits that two lines' parities differ in, by the finest classes that both carry; left and right give a line's columns by name.

    The halves of 128 classes are bit6 and parity xor bit6; the quarters of 256 are both, bit6 and bit7 each xor both, and the xor of all.
    """
    p, a, b, c = (left(name).bitwiseXOR(right(name)) for name in PARITIES)
    quarters = F.bit_count(c) + F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(c)) + F.bit_count(p.bitwiseXOR(a).bitwiseXOR(b).bitwiseXOR(c))
    return F.coalesce(quarters, F.bit_count(a) + F.bit_count(p.bitwiseXOR(a)), F.bit_count(p))


def most_apart(n: Column, m: Column) -> Column:
    """Words that two similar sets of n and m words may not share: total less twice the shared ones."""
    return n + m - 2 * F.ceil((n + m) * (SHARE[0] / SHARE[1]) - 1e-9)


def near_by(left, right) -> Column:
    """Parities allow that the lines are similar."""
    return differing(left, right) * SHARE[1] <= (left("n") + right("n")) * (SHARE[1] - 2 * SHARE[0])


def verified(pairs: DataFrame, first: DataFrame, lines: Callable[[DataFrame], DataFrame], nearest: int = 0) -> DataFrame:
    """Numbers of the lines of pairs (num, other, d) whose word sets are similar to the other's; only these lines' words are looked up.

    lines gives the lines of documents whose ids it is given. A line is looked at with so many others of least d first, one after the
    other, and only while none is similar; with all the rest after that. So a group of near copies takes about one pair a line. Wide
    parities go to the pairs first, and texts only to those that they leave.
    """
    ids = pairs.select("num").unionByName(pairs.select(F.col("other").alias("num"))).distinct()
    ids = bounded(first.join(bounded(ids), "num").select("num", "lid", "lid2", "doc_id", "line_no"))
    same = [F.col(k) == x for k, x in zip(("lid", "lid2"), identity(F.col("line")), strict=True)]
    texts = lines(ids).join(ids, ["doc_id", "line_no"]).where(same[0] & same[1])
    texts = texts.select("num", "line", words(F.col("line")).alias("w")).select("num", "line", F.size("w").alias("n"), *parities(F.col("w")))
    texts = cut(texts.dropDuplicates(["num"]))  # rows of one id may repeat a line
    gone = None
    for _ in range(nearest):
        now = pairs.groupBy("num").agg(F.min(F.struct("d", "other")).alias("now"))
        sure = cut(similar(now.select("num", F.col("now.other").alias("other")), texts))
        gone = sure if gone is None else gone.unionByName(sure)
        pairs = cut(pairs.join(now.join(sure, "num", "left_anti"), "num").where(F.col("other") != F.col("now.other")).select("num", "other", "d"))
    last = similar(pairs.select("num", "other"), texts)
    return last if gone is None else gone.unionByName(last)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Numbers of the lines of pairs (num, other) whose word sets in texts are similar to the other's."""
    bits = [f"p{q}" for q in range(PARITY)]
    one = texts.select("num", "n", *bits)
    two = texts.select(F.col("num").alias("other"), F.col("n").alias("m"), *[F.col(x).alias("_" + x) for x in bits])
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col("_" + x))) for x in bits), F.lit(0))
    close = pairs.join(one, "num").join(two, "other").where(differ <= most_apart(F.col("n"), F.col("m"))).select("num", "other")
    a, b = texts.select("num", F.col("line").alias("l1")), texts.select(F.col("num").alias("other"), F.col("line").alias("l2"))
    both = close.join(a, "num").join(b, "other").select("num", words(F.col("l1")).alias("s1"), words(F.col("l2")).alias("s2"))
    return both.where(F.size(F.array_intersect("s1", "s2")) * SHARE[1] >= (F.size("s1") + F.size("s2")) * SHARE[0]).select("num").distinct()


OWN = ("num", "doc_id", "line_no", "n", *PARITIES)


def earlier(left, right) -> Column:
    return (right("doc_id") < left("doc_id")) | ((right("doc_id") == left("doc_id")) & (right("line_no") < left("line_no")))


def settled(first: DataFrame, lines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Round one: numbers of lines that are similar to the first line of one of their prefix words.

    Each line is compared with the first line of each of some of its prefix words, and the words of the one whose parities are nearest
    are looked at. That settles most members of a large group of near copies by one pair each.
    """
    c = F.col
    w = Window.partitionBy("word").orderBy("doc_id", "line_no")
    some = F.filter("prefix", lambda h: h.bitwiseAND(F.lit(WORD_BITS)) % EVERY == 0)
    met = first.select(*OWN, F.explode(some).alias("word")).withColumn("word", c("word").bitwiseAND(F.lit(WORD_BITS)))
    met = met.withColumn("o", F.first(F.struct(*OWN)).over(w))
    star = lambda x: c(f"o.{x}")
    fits = earlier(c, star) & (F.least("n", star("n")) * SHARE[1] >= (c("n") + star("n")) * SHARE[0]) & near_by(c, star)
    met = met.where(fits).select("num", F.struct(differing(c, star).alias("d"), star("num").alias("other")).alias("best"))
    nearest = met.groupBy("num").agg(F.min("best").alias("best")).select("num", c("best.other").alias("other"), c("best.d").alias("d"))
    return cut(verified(cut(nearest), first, lines))


def matched(first: DataFrame, lines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Round two: numbers of the lines still open that are similar to a line that occurs earlier.

    Two similar lines share a word of their prefixes, and at the first word they share, both still have as many words to come as they
    must share. The words before it differ, so a pair is dropped under a word that follows the same word in both lines.
    """
    c = F.col
    each = first.select(*OWN, "open", "prefix", F.posexplode("prefix").alias("at", "key"))
    before = F.when(c("at") > 0, F.get("prefix", c("at") - 1).bitwiseAND(F.lit(BEFORE_BITS)))
    fine = F.when(c("bit6").isNotNull(), F.struct(*PARITIES[1:]))  # takes no room in most rows
    rows = each.select("num", "doc_id", F.shiftleft(c("line_no").cast("long"), 1).bitwiseOR(c("open").cast("long")).alias("line"), "n", "at", before.alias("before"), "parity", fine.alias("fine"), c("key").bitwiseAND(F.lit(WORD_BITS)).alias("word"))
    sizes = F.shiftleft(c("n").cast("long"), 32).bitwiseOR(c("at").cast("long"))  # two numbers in the room of one
    # both sides name and read the same columns, and each condition takes in both, so that one shuffle serves both
    side = lambda side: rows.select(*[c(x).alias(side + x) for x in ("num", "doc_id", "line", "before", "parity", "fine", "word")], sizes.alias(side + "sizes"))
    one, two = side("l_"), side("r_")

    def of(side: str) -> Callable[[str], Column]:
        own = {
            "n": F.shiftright(c(side + "sizes"), 32),
            "at": c(side + "sizes").bitwiseAND(F.lit(0xFFFFFFFF)),
            "line_no": F.shiftright(c(side + "line"), 1),
            "open": c(side + "line").bitwiseAND(F.lit(1)) == 1,
            **{x: c(f"{side}fine.{x}") for x in PARITIES[1:]},
        }
        return lambda x: own[x] if x in own else c(side + x)

    left, right = of("l_"), of("r_")
    order = (left("n") > right("n")) | ((left("n") == right("n")) & (left("num") > right("num")))
    enough = F.least(left("n") - left("at"), right("n") - right("at")) * SHARE[1] >= (left("n") + right("n")) * SHARE[0]
    first_shared = F.coalesce(left("before") != right("before"), F.lit(True))
    later = earlier(left, right)
    asked = (later & left("open")) | (earlier(right, left) & right("open"))
    pairs = one.join(two, (left("word") == right("word")) & order & enough & near_by(left, right) & first_shared & asked)
    pair = lambda a, b: F.when(later, a("num")).otherwise(b("num"))
    pairs = cut(pairs.select(pair(left, right).alias("num"), pair(right, left).alias("other"), differing(left, right).alias("d")).distinct())
    release(first)
    return verified(pairs, first, lines, NEAREST)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row: removed holds the numbers, from 0, of lines that go.

    Lines end at line feeds; a text of k line feeds has k + 1 lines, also the empty text; null counts as empty. A line goes if a line
    earlier in (doc_id, line number) order, whether that goes or not, has a word set of Jaccard similarity 0.8 or more. Lines without
    words stay. Rows of a null id keep all lines and remove none elsewhere; rows of one id are one place, so lines at one line
    number of theirs don't remove each other. Long lines and texts are taken whole. Other columns are not looked at. No rows: none.
    """
    lines = lines_of(docs, id_col, text_col)
    first, at = stored(distinct_lines(lines).withColumn("num", F.monotonically_increasing_id()))
    release(docs)

    def of(ids: DataFrame) -> DataFrame:
        wanted = bounded(ids.select(F.col("doc_id").alias("_w")).distinct())
        return lines_of(docs.join(wanted, F.col(id_col) == F.col("_w"), "left_semi"), id_col, text_col)

    early = settled(first, of)
    first, _ = stored(first.join(bounded(early.withColumn("open", F.lit(0))), "num", "left").withColumn("open", F.coalesce("open", F.lit(1))))
    drop(docs.sparkSession, at)
    release(docs)
    gone = early.unionByName(cut(matched(first, of)))
    key = lambda lid, at: F.shiftleft(lid, 32).bitwiseOR(at.cast("long"))
    kept = first.join(gone, "num", "left_anti").groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(key(F.col("lid"), F.col("line_no"))).alias("kept"))
    whole = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    keys = F.filter(F.transform("l", lambda x, k: F.when(x.rlike(HAS_WORDS), key(F.xxhash64(x), k))), lambda k: k.isNotNull())
    own = docs.select(F.col(id_col).alias("doc_id"), whole.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lines"), keys.alias("keys"))
    none = F.array().cast("array<long>")
    later = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except("keys", F.coalesce("kept", none)))
    removed = F.transform(later, lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    out = own.join(kept, own["doc_id"] == kept["_d"], "left").select("doc_id", "n_lines", removed.alias("removed"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def kept_text(text: Column, removed: Column) -> Column:
    """text without the lines numbered in removed."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(removed, k)), "\n")


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
