"""A JSON array of objects in one file, read by many tasks.

The file is cut at every ``}`` by Spark's text reader, which splits it like any text.  A cut ends an item if it lies outside
strings and closes the outermost object.  Whether it does depends on all that comes before, but only through three sums:
quotes, braces and items so far.  They are added up inside each split, then over the splits of a file (a row each), so
every piece learns which item it belongs to without any task reading a file from its start.  The pieces are written once; the sums
are taken without their texts, and only items that were cut into several pieces are moved, to be put together by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage

SPLIT = ["file", "start"]
FEW_PIECES = 200_000     # pieces of cut items, below which their places are broadcast and all other texts stay where they are


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), pos (unique, in order inside it), value: the text between closing braces, with counts of quotes and
    opening braces, and whether it begins an array."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"), "value")
    runs = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)       # a quote begins or ends every run but the first

    def braces(rest: int) -> Column:
        return F.aggregate(F.filter(runs, lambda r, i: i % 2 == rest), F.lit(0), lambda n, r: n + F.length(r) - F.length(F.replace(r, F.lit("{"))))
    return raw.select("*", (F.size(runs) - 1).alias("quotes"), braces(0).alias("even"), braces(1).alias("odd"), F.col("value").rlike(r"^[\s\x{FEFF}]*\[").alias("array"))


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """``pieces`` with ``name``: the sum of ``value`` over all earlier pieces of the file."""
    inside = Window.partitionBy(*SPLIT).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*SPLIT).agg(F.sum(value).alias("_sum"))          # a row for each split
    before = sums.select(*SPLIT, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    zero = F.lit(0)
    return pieces.withColumn("_here", F.coalesce(F.sum(value).over(inside), zero)).join(before, SPLIT) \
        .withColumn(name, F.col("_here") + F.col("_before")).drop("_here", "_before")


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, item) for each object of the arrays in ``path``: its JSON text.  A file that does not hold one array of objects is an error
    when it is read; whitespace and a byte order mark around the array are not."""
    texts = cut_lineage(_pieces(spark, path), "array-pieces")
    pieces = _running(texts.drop("value"), "quotes", "_q")
    inside = F.col("_q") % 2 == 1                                          # the piece begins inside a string
    ends_inside = (F.col("_q") + F.col("quotes")) % 2 == 1
    opened = F.when(inside, F.col("odd")).otherwise(F.col("even"))
    closed = F.when(ends_inside, F.lit(0)).otherwise(F.lit(1))
    pieces = pieces.withColumns({"inside": inside, "opened": opened, "net": opened - closed}).drop("quotes", "even", "odd", "_q")
    pieces = _running(pieces, "net", "depth")
    closes = (F.col("net") < F.col("opened")) & (F.col("depth") + F.col("net") == 0)
    pieces = _running(pieces.withColumn("closes", closes.cast("int")), "closes", "number")
    alone = (F.col("closes") == 1) & (F.col("depth") == 0) & ~F.col("inside")          # a whole item
    pieces = cut_lineage(pieces.select("file", "start", "pos", "array", "closes", "number", alone.alias("alone")), "array-cuts")
    # The end of an array is a piece behind the last item; without it the last cut was the end of the file.
    begins = F.min_by("array", F.struct("start", "pos"))
    ends = pieces.groupBy("file").agg(F.max("number").alias("last"), F.sum("closes").alias("items"), begins.alias("array")).where("last < items or not array").first()
    if ends is not None:
        raise ValueError(f"{ends['file']} " + ("ends inside an item" if ends["array"] else "does not hold a JSON array"))
    cut = pieces.where(~F.col("alone")).select("pos", "closes", "number")
    marked = texts.select("file", "start", "pos", "value").join(F.broadcast(cut) if cut.count() <= FEW_PIECES else cut, "pos", "left")
    one = marked.where("number is not null").groupBy("file", "number").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("start", "pos", "value")))["value"], "}").alias("text"), F.max("closes").alias("whole"))
    rest = (F.col("whole") == 0) & ~F.col("text").rlike(r"^[\s\x{FEFF}]*(\[\s*)?\]\s*$")
    wrong = F.when(rest, F.concat("file", F.lit(" ends inside an item")))
    item = F.concat(F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]?\s*", ""), F.lit("}"))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).when(F.col("whole") == 1, item)
    whole = marked.where("number is null").withColumnRenamed("value", "text").select("file", item.alias("item"))
    return whole.unionByName(one.select("file", checked.alias("item")).where("item is not null"))
