"""Changed lines and the definitions around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How definitions look; group 1 is the name.
CLASS = r"^\s*(?:export\s+|pub\s+|public\s+|abstract\s+)*(?:class|struct|interface|trait|enum)\s+([A-Za-z_$][\w$]*)"
FUNCTION = r"^\s*(?:export\s+|pub\s+|public\s+|static\s+|async\s+)*(?:def|fn|function|func(?:\s+\([^)]*\))?)\s+([A-Za-z_$][\w$]*)"
TYPED = r"^(?!\s*(?:return|if|for|while|switch|catch|throw|yield|await|else|new)\b)\s*(?:[A-Za-z_][\w<>:,*&\[\]]*\s+)+[*&]*([A-Za-z_]\w*)\s*\([^;]*$"


def definitions(files: DataFrame) -> DataFrame:
    """(path, line, indent, kind, name) of every line of files (path, text) that begins a definition."""
    lines = files.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("k", "t")).where(F.col("t").rlike(CLASS) | F.col("t").rlike(FUNCTION) | F.col("t").rlike(TYPED))
    name = F.coalesce(*[F.nullif(F.regexp_extract("t", form, 1), F.lit("")) for form in (CLASS, FUNCTION, TYPED)])
    kind = F.when(F.col("t").rlike(CLASS), "class").otherwise("function")
    return lines.select("path", (F.col("k") + 1).alias("line"), F.length(F.regexp_extract("t", r"^([ \t]*)", 1)).alias("indent"), kind.alias("kind"), name.alias("name"))


def enclosing(places: DataFrame, files: DataFrame) -> DataFrame:
    """places (path, line) with symbol, kind and start_line of the nearest definition at or before the line.

    Functions of Python files carry the name of the last class before them that is indented less. No definition: <file>, file, 1.
    One as-of pass: places and definitions of a path are sorted by line together, and each takes the last definition seen.
    """
    found = definitions(files)
    at = Window.partitionBy("path").orderBy("line", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("line")
    classes = F.collect_list(F.when(F.col("kind") == "class", F.struct("indent", "name"))).over(before)  # of one file
    owner = F.try_element_at(F.filter(classes, lambda x: x["indent"] < F.col("indent")), F.lit(-1))["name"]
    owned = F.when((F.col("kind") == "function") & F.col("path").endswith(".py") & owner.isNotNull(), F.concat(owner, F.lit("."), "name")).otherwise(F.col("name"))
    symbols = found.select("path", "line", F.lit(0).alias("place"), F.struct(owned.alias("symbol"), "kind", F.col("line").alias("start_line")).alias("d"))
    wanted = places.select("path", "line").distinct().withColumns({"place": F.lit(1), "d": F.lit(None).cast(symbols.schema["d"].dataType)})
    seen = symbols.unionByName(wanted).withColumn("d", F.last("d", True).over(at)).where("place = 1")
    known = seen.select("path", "line", F.coalesce("d.symbol", F.lit("<file>")).alias("symbol"), F.coalesce("d.kind", F.lit("file")).alias("kind"), F.coalesce("d.start_line", F.lit(1)).alias("start_line"))
    return places.join(known, ["path", "line"])


def sinks(declared: Column, text: Column, most: int = 4) -> Column:
    """Declared sink names, else the first names of more than two characters that the text calls."""
    called = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][\w.]*)\s*\("), 1))
    return F.slice(F.when(F.size(declared) > 0, declared).otherwise(F.filter(called, lambda x: F.length(x) > 2)), 1, most)
