"""Readers of landed files: JSON items, feeds, papers, vulnerabilities, curated sheets, discoveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schemas, vocab
from strandline.functions import rules, text, times, urls
from strandline.operators.dedupe import dedupe_first, dedupe_last
from strandline.sources import jsonarray


def json_records(spark: SparkSession, path: str, schema: str = schemas.RAW_ITEM) -> DataFrame:
    """Files that each hold one JSON array of items, however large: a file is read by many tasks.

    A missing path is an error at once; a file that is no array of objects, or ends inside an item, is one when it
    is read, and so is an item that is no JSON.
    """
    rows = jsonarray.array_items(spark, path)
    read = F.from_json("item", schema, {"mode": "FAILFAST"})
    return rows.select(read.alias("r")).select("r.*")


def _first_in_file(df: DataFrame, k: int) -> DataFrame:
    """First k rows of every file, in file order."""
    w = Window.partitionBy("file").orderBy("_pos")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("_pos", F.monotonically_increasing_id())


def feed(spark: SparkSession, path: str, kind: str = "rss", max_items: int | None = None) -> DataFrame:
    """RSS or Atom documents to items: file, title, url, date_published, full_text; all items of a file, or the first ``max_items``."""
    atom = kind == "atom"
    raw = _xml(spark, path, "entry" if atom else "item", schemas.ATOM_ENTRY if atom else schemas.RSS_ITEM)
    link = F.get(F.transform("link", lambda x: x["_href"]), F.lit(0)) if atom else F.col("link")
    e = F.lit("")
    dates = ["published", "updated"] + ([] if atom else ["pubDate"])
    date = F.coalesce(*[F.nullif(F.trim(c), e) for c in dates])
    body = F.coalesce(*[F.nullif(F.trim(c), e) for c in ("summary", "description", "content")], e)
    items = (raw if max_items is None else _first_in_file(raw, max_items)).select(
        "file", "_pos", text.xml_text(F.col("title")).alias("title"), F.trim(F.coalesce(link, e)).alias("url"),
        times.parse_date(date).alias("date_published"), text.xml_text(body).alias("full_text"))
    return items.where((F.col("title") != "") & (F.col("url") != "")).drop("_pos")


def paper_entries(spark: SparkSession, path: str) -> DataFrame:
    """Paper-archive Atom entries: https URL from the id, first row per URL across files in path order."""
    raw = _xml(spark, path, "entry", schemas.PAPER_ENTRY)
    one_space = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    rows = raw.select("file", "_pos", one_space("title").alias("title"), F.regexp_replace(one_space("id"), "^http://", "https://").alias("url"),
                      F.lit("arXiv").alias("publisher"), times.parse_date(F.col("published")).alias("date_published"),
                      F.lit("exact").alias("date_confidence"), F.lit("research_finding").alias("source_type"),
                      one_space("summary").alias("full_text"), F.lit("high").alias("trust_tier"))
    return dedupe_first(rows.withColumn("_order", F.struct("file", "_pos")), "url", "_order").drop("_order", "_pos", "file")


def vuln_json(spark: SparkSession, path: str, terms: list[str] | None = None, *, multi_line: bool = False) -> DataFrame:
    """Vulnerability responses: entries whose first description has a relevant term, first per id."""
    raw = spark.read.schema(schemas.VULN_RESPONSE).option("multiLine", multi_line).json(path)
    cve = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_row"),
                     F.posexplode("vulnerabilities").alias("_i", "v"))
    rows = cve.select(F.col("v.cve.id").alias("cve_id"), F.col("v.cve.published").alias("published"),
                      F.coalesce(F.get("v.cve.descriptions", F.lit(0))["value"], F.lit("")).alias("description"),
                      F.struct("file", "_row", "_i").alias("_order"))
    rows = rows.withColumn("_low", F.lower("description")).where(rules.any_phrase("_low", terms or vocab.VULN_FEED_TERMS))
    return dedupe_first(rows, "cve_id", "_order").select(
        "cve_id", F.concat("cve_id", F.lit(": "), F.substring("description", 1, 140)).alias("title"),
        F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cve_id").alias("url"), F.lit("NVD").alias("publisher"),
        times.parse_date(F.col("published")).alias("date_published"), F.lit("vulnerability").alias("source_type"),
        F.lit("primary").alias("trust_tier"), F.col("description").alias("full_text"))


def _curated_tier(publisher: Column) -> Column:
    low = F.lower(publisher)
    whens = [F.when(rules.any_phrase(low, phrases), F.lit(t)) for t, phrases in vocab.CURATED_TIER_RULES.items()]
    return F.coalesce(*whens, F.lit("medium"))


def curated_sheets(spark: SparkSession, sheets: dict[str, str]) -> DataFrame:
    """Exported sheets (name -> CSV path) to curated rows; the last row per id wins.

    ``Published`` is an ISO date or a spreadsheet serial day.  Rows without title, URL or date
    are skipped.
    """
    parts = []
    for i, (sheet, path) in enumerate(sheets.items()):
        tags, score, category = vocab.CURATED_SHEETS.get(sheet, (["curated"], 70, vocab.UNCATEGORISED))
        df = (spark.read.schema(schemas.CURATED_ROW).option("header", True).option("multiLine", True).option("escape", '"').csv(path))
        parts.append(df.select("*", F.lit(sheet).alias("sheet_category"), rules.lit_array(tags).alias("tags"),
                               F.lit(score).alias("ai_specificity_score"), F.lit(category).alias("category"),
                               F.struct(F.lit(i), F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_order")))
    raw = reduce(DataFrame.unionByName, parts)
    date = F.when(F.col("Published").rlike(r"^\d+(\.\d+)?$"), times.serial_date(F.col("Published").try_cast("double"))) \
        .otherwise(times.parse_date(F.col("Published")))
    clean = {c.lower(): text.clean_plaintext(c) for c in ("Title", "URL", "Summary", "Content")}
    rows = raw.select(*[c.alias(n) for n, c in clean.items()], date.alias("date_published"), "sheet_category", "tags",
                      "ai_specificity_score", "category", "_order")
    rows = rows.where((F.col("title") != "") & (F.col("url") != "") & F.col("date_published").isNotNull())
    body = F.coalesce(F.nullif("content", F.lit("")), "summary")
    rows = rows.withColumn("publisher", urls.curated_publisher(F.col("url"))).withColumn("full_text", body)
    rows = rows.withColumn("content_hash", text.content_hash(F.col("title"), F.col("url"), F.col("full_text")))
    kind = F.coalesce(*[F.when(F.col("publisher").contains(p), F.lit(t)) for p, t in vocab.CURATED_PUBLISHER_TYPES], F.lit("security_blog"))
    rows = rows.withColumns({"id": F.concat(F.lit("curated-"), F.substring("content_hash", 1, 24)), "source_type": kind,
                             "trust_tier": _curated_tier(F.col("publisher")),
                             "source_text_quality": F.when(F.col("content") != "", F.lit("partial_text")).otherwise(F.lit("summary_only"))})
    return dedupe_last(rows, "id", "_order").drop("_order", "content")


def discovery_results(df: DataFrame, as_of: Column, publishers: dict[str, str] | None = None) -> DataFrame:
    """Discovery results (url, title, found_at): first per URL, publisher by host, date from the URL."""
    firsts = dedupe_first(df.withColumn("_order", F.struct("found_at", F.coalesce("title", F.lit("")))), "url", "_order").drop("_order")
    inferred = urls.infer_date(F.col("url"), as_of).cast("timestamp_ntz")
    return (firsts.withColumn("date_published_actual", inferred).withColumns({
        "title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url")),
        "publisher": urls.lookup_publisher(F.col("url"), publishers), "date_published": as_of,
        "date_confidence": F.when(F.col("date_published_actual").isNotNull(), F.lit("estimated")).otherwise(F.lit("low")),
        "source_type": F.lit("research_finding"), "trust_tier": F.lit("medium"),
        "precomputed_daily": F.col("date_published_actual").isNull() | times.within_days(F.col("date_published_actual"), 2, as_of)}))


def feed_registry(spark: SparkSession, path: str) -> DataFrame:
    """Feed definitions supplied as JSON lines: name, publisher, kind, url, source_type, trust_tier, enabled."""
    return spark.read.schema("name string, publisher string, kind string, url string, source_type string, trust_tier string, "
                             "retrieval_method string, enabled boolean").json(path)
