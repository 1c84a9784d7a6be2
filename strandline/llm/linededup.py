"""Line deduplication by distinct-site spread, in DataFrame operations only.

Each line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge in the aggregation, on
the map side first.  Lines whose estimate is far from the threshold are decided by it; lines near it are
counted exactly.  A line on ``min_sites`` sites or more is boilerplate: its first occurrence (smallest key,
then line number) stays, all others are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, row_key

MIN_SITES = 10
LG_K = 12                 # registers of a sketch: 2**12, relative standard error 1.6 %
BAND = 0.1                # estimates within 10 % of the threshold (six standard errors) are counted exactly


def _keyed(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    k = row_key(F.col(text).cast("string"))
    return docs.select(F.col(key).cast("long").alias("id"), k["a"].alias("ta"), k["b"].alias("tb"),
                       F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(text).cast("string").alias("text"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(id, ta, tb, site, pos, ha, hb) of every line that is not blank; ha and hb hash the trimmed line."""
    each = _keyed(docs, key, text, site).select("id", "ta", "tb", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.btrim(F.col("line"), F.lit(" \t\r "))
    return (each.select("id", "ta", "tb", "site", "pos", bare.alias("line")).where("line <> ''")
            .select("id", "ta", "tb", "site", "pos", F.xxhash64("line").alias("ha"), F.xxhash64(F.lit(1), "line").alias("hb")))


def boilerplate(occurrences: DataFrame, *, min_sites: int = MIN_SITES) -> DataFrame:
    """(ha, hb, first) of the lines on ``min_sites`` distinct sites or more; first is their first occurrence."""
    last = (1 << 63) - 1
    first = F.min(F.struct(F.coalesce("id", F.lit(last)).alias("id"), F.col("pos").alias("pos"), "ta", "tb")).alias("first")
    sketched = occurrences.groupBy("ha", "hb").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first)
    spread = sketched.select("ha", "hb", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = cut_lineage(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "lines-spread")
    near = likely.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = (occurrences.join(near.select("ha", "hb"), ["ha", "hb"], "left_semi").select("ha", "hb", "site").distinct()
             .groupBy("ha", "hb").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites))
    sure = likely.where(F.col("sites") > min_sites * (1 + BAND))
    return sure.select("ha", "hb", "first").unionByName(near.join(exact, ["ha", "hb"]).select("ha", "hb", "first"))


def _without(text: Column, drop: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(drop, i)), "\n")


def remove_boilerplate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source",
                       min_sites: int = MIN_SITES, removed: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; every row and every column stays.

    ``removed`` names an extra column with the number of lines taken.  A null text stays null, a null site is a
    site of its own, blank lines are never boilerplate.  Rows with a null key come last in the order of
    occurrences; repeated rows (same key and text) count as one occurrence, so all of them keep a first line.
    A document that consists of boilerplate found earlier keeps its row with an empty text.
    """
    found = cut_lineage(boilerplate(lines(docs, key, text, site), min_sites=min_sites), "lines-boilerplate")
    last = (1 << 63) - 1
    met = lines(docs, key, text, site).join(found, ["ha", "hb"])
    here = F.struct(F.coalesce("id", F.lit(last)).alias("id"), F.col("pos").alias("pos"), "ta", "tb")
    drops = met.where(here != F.col("first")).groupBy("id", "ta", "tb").agg(F.collect_set("pos").alias("drop"))
    k = row_key(F.col(text).cast("string"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), k["a"].alias("ka"), k["b"].alias("kb"))
    same = whole["k"].eqNullSafe(drops["id"]) & (whole["ka"] == drops["ta"]) & (whole["kb"] == drops["tb"])
    joined = whole.join(drops, same, "left")
    new = F.when(F.col("drop").isNull(), F.col("row")[text]).otherwise(_without(F.col("row")[text], F.col("drop")))
    columns = [(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    if removed is not None:
        columns.append(F.coalesce(F.size("drop"), F.lit(0)).cast("int").alias(removed))
    return joined.select(*columns)


ORACLE = """
WITH each AS (
  SELECT doc_id, coalesce(source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents
), bare AS (
  SELECT doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS body FROM each
), spread AS (
  SELECT body, min((doc_id, pos)) AS first FROM bare WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= 10
), marked AS (
  SELECT b.*, s.body IS NOT NULL AND (b.doc_id, b.pos) <> s.first AS gone FROM bare b LEFT JOIN spread s USING (body)
)
SELECT d.doc_id, d.source, max(len(string_split(d.text, chr(10)))) AS n_lines,
       count(*) FILTER (gone)::INTEGER AS n_removed,
       coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT gone), CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text
FROM documents d LEFT JOIN marked m USING (doc_id)
GROUP BY d.doc_id, d.source, d.text
"""
