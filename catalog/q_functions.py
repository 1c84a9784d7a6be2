"""Scalar string, URL, array, JSON and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cte, query
from catalog.views import (AS_OF, TEST_TAGS, as_of, claims, events, sections, sources, sql_any, sql_canonical_url,
                           sql_list, sql_map, sql_pick, table, tagged, understood)
from strandline import vocab
from strandline.functions import rules, text, times, urls, variants
from strandline.operators import classify


def pages(spark, sf):
    return table(spark, sf, "pages")


def _sql_rules(expr: str, steps) -> str:
    for pattern, repl, opts in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{repl}', '{opts}')"
    return expr


# The cleaner restated for RE2: no lookaround, repeats of at most 1,000.
TAGS = [("<script(?s:.)*?</script>", " ", "gi"), ("<style(?s:.)*?</style>", " ", "gi"), ("<[^>]+>", " ", "g")]
ENTITIES = [("&nbsp;", " ", "g"), ("&amp;", "&", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&#x2F;", "/", "g"),
            ("&#39;", "''", "g"), ("&quot;", '"', "g"), ("&apos;", "''", "g")]
MORE = [("&mdash;", " — ", "g"), ("&ndash;", " – ", "g"), ("&ldquo;|&rdquo;", '"', "g"), ("&lsquo;|&rsquo;", "''", "g"),
        ("&hellip;", "...", "g"), ("&bull;", " ", "g"), ("&middot;", " ", "g")]
TAIL_ENTITIES = [("&#[0-9]+;", " ", "g"), ("&[a-zA-Z]+;", " ", "g")]
MATH = [(r"[\x{a0}\x{202f}\x{2000}-\x{200b}\x{2028}\x{2029}\x{feff}]", " ", "g"), (r"[\x{ad}\x{200c}-\x{200f}]", "", "g"),
        (r"\$\$(?s:.){0,600}?(?s:.){0,600}?\$\$", " ", "g"), (r"\\\[(?s:.){0,600}?(?s:.){0,600}?\\\]", " ", "g"),
        (r"\\\((?s:.){0,400}?\\\)", " ", "g"), (r"\$[^$\n]*\\[a-zA-Z][^$\n]*\$", " ", "g"),
        (r"\\[a-zA-Z]+(?:\[[^\]]{0,50}\])?", " ", "g"), ("~", " ", "g")]
MARKDOWN = [("`{3}[^\\n]*\\n?", " ", "g"), ("`([^`\\n]+)`", r"\1", "g"), (r"(?m)^#{1,6}\s+", "", "g"),
            (r"\*{2,3}([^*\n]+)\*{2,3}", r"\1", "g"), (r"_{2}([^_\n]+)_{2}", r"\1", "g"), (r"\*([^*\n]+)\*", r"\1", "g"),
            (r"\[([^\]]+)\]\([^)]+\)", r"\1", "g"), (r"!\[[^\]]*\]\([^)]+\)", " ", "g")]
FEED = [(r"\bThe post .{5,120} appeared first on .{3,80}\.\s*", " ", "gi"), (r"\bContinue reading\.{0,3}\s*»?\s*", " ", "gi"),
        (r"\bRead (the full story|more)\.{0,3}\s*»?\s*", " ", "gi"), (r"\bSubscribe (to|now).{0,60}\.\s*", " ", "gi"),
        (r"\bClick here to .{5,80}\.\s*", " ", "gi"),
        (r"\b(View|See) (full|original) (article|post|story).{0,30}\.\s*", " ", "gi"),
        ("[©®™°]", " ", "g"), ("[-=_|*~]{4,}", " ", "g"), (r"[ \t]+", " ", "g"), (r"\n{3,}", "\n\n", "g")]


def sql_clean_plaintext(expr: str) -> str:
    steps = TAGS + ENTITIES + MORE + TAIL_ENTITIES + MATH + MARKDOWN + FEED
    return _sql_rules(_sql_rules(expr, steps), [(r"^\s+|\s+$", "", "g")])


def sql_clean_text(expr: str) -> str:
    steps = [TAGS[2]] + ENTITIES + TAIL_ENTITIES + [
        (r"[\x{a0}\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}\x{ad}]", " ", "g"), ("[©®™]", "", "g"), (r"\s+", " ", "g"),
        (r"^\s+|\s+$", "", "g")]
    return _sql_rules(expr, steps)


@query("clean_plaintext", f"SELECT page_id, {sql_clean_plaintext('html')} AS clean_text FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.clean_plaintext("html").alias("clean_text"))


@query("clean_text", f"SELECT page_id, {sql_clean_text('html')} AS clean_text FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.clean_text("html").alias("clean_text"))


@query("clean_sources", f"""
  SELECT position, CASE WHEN position % 5 = 0 THEN title ELSE {sql_clean_text('title')} END AS title,
         CASE WHEN position % 5 = 0 THEN full_text ELSE {sql_clean_plaintext('full_text')} END AS full_text,
         full_text AS raw_text, 'clean-v2.0' AS cleaning_version FROM sources""", ["sources"])
def _(spark, sf):
    """Every fifth document is already stamped and must come back unchanged."""
    from strandline.plans.ingest import clean_sources
    rows = sources(spark, sf).withColumn(
        "cleaning_version", F.when(F.col("position") % 5 == 0, F.lit(vocab.CLEANING_VERSION)))
    rows = rows.withColumn("raw_text", F.col("full_text"))
    return clean_sources(rows).select("position", "title", "full_text", "raw_text", "cleaning_version")


@query("xml_text", "SELECT page_id, " + _sql_rules("html", [
    TAGS[2], ENTITIES[0], ENTITIES[1], ENTITIES[4], (r"\s+", " ", "g"), (r"^\s+|\s+$", "", "g")]) + " AS plain FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", text.xml_text(F.col("html")).alias("plain"))


# The documents hold no fences, so two are built: around the whole text, and around all of it but the first line.
SQL_REST = "regexp_replace(substr(text, length(split_part(text, chr(10), 1)) + 2), '^\\s+|\\s+$', '', 'g')"
SQL_WHOLE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("extract_code_blocks", f"""
  SELECT doc_id, b.language, b.content, 'intro x ' || chr(10) || whole || ' then ' || rest || ' tail' AS processed FROM (
    SELECT *, unnest(list_filter([{{language: 'sql', content: whole}}, {{language: 'text', content: rest}}], lambda b: b.content <> '')) AS b
    FROM (SELECT doc_id, {SQL_WHOLE} AS whole, {SQL_REST} AS rest FROM documents))""")
def _(spark, sf):
    rest = F.substring("text", F.length(F.substring_index("text", "\n", 1)) + 2, F.length("text"))
    raw = F.concat(F.lit("intro `x` \n```sql\n"), "text", F.lit(" \n``` then ```\n"), rest, F.lit("\n``` tail"))
    return table(spark, sf, "documents").withColumn("raw", raw).select(
        "doc_id", F.inline(text.code_blocks(F.col("raw"))), text.unfenced(F.col("raw")).alias("processed"))


@query("json_field_types", """
  SELECT field, found, count(*) AS rows FROM (
    SELECT 'n' AS field, CASE WHEN doc_id % 7 = 0 THEN 'string' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'array' ELSE 'number' END AS found FROM documents
    UNION ALL SELECT 'text', CASE WHEN doc_id % 5 = 0 THEN 'object' ELSE 'string' END FROM documents)
  WHERE NOT (field = 'n' AND found = 'number') AND NOT (field = 'text' AND found = 'string') GROUP BY ALL""")
def _(spark, sf):
    """Documents as JSON with fields of other types planted by their id."""
    doc = F.col("doc_id")
    number = F.when(doc % 7 == 0, F.lit('"n": "7", ')).when(doc % 11 == 0, F.lit("")).when(doc % 13 == 0, F.lit('"n": [1], ')).otherwise(F.concat(F.lit('"n": '), doc.cast("string"), F.lit(", ")))
    body = F.to_json(F.struct("text"))
    whole = F.when(doc % 5 == 0, F.concat(F.lit('{"text": '), body, F.lit("}"))).otherwise(body)
    rows = table(spark, sf, "documents").select(F.concat(F.lit("{"), number, F.substring(whole, F.lit(2), F.length(whole))).alias("json"))
    return variants.wrong_types(rows, "json", {"n": ("number",), "text": ("string",)})


V4 = r"\b((?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"


@query("extract_iocs", f"""
  SELECT doc_id,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?i)\\bCVE-[0-9]{{4}}-[0-9]{{4,7}}\\b'), lambda x: upper(x)))), '|') AS cves,
    array_to_string(list_sort(list_distinct(regexp_extract_all(body, '{V4}'))), '|') AS ips,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, 'https?://[^\\s"''<>()\\[\\]{{}},;]+'), lambda x: regexp_replace(x, '[.,;)]+$', '')))), '|') AS urls,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?i)(?:sha-?256|hash)[\\s:=]+([0-9a-fA-F]{{64}})\\b', 1), lambda x: lower(x)))), '|') AS sha256
  FROM (SELECT doc_id, text || ' see https://' || source || '.example.org/a?b=' || doc_id || '). CVE-2024-' || (10000 + doc_id)
         || ' sha256: ' || sha256(text) AS body FROM documents)""")
def _(spark, sf):
    doc = F.col("doc_id")
    body = F.concat("text", F.lit(" see https://"), "source", F.lit(".example.org/a?b="), doc.cast("string"),
                    F.lit("). CVE-2024-"), (doc + 10000).cast("string"), F.lit(" sha256: "), F.sha2("text", 256))
    flat = lambda c: F.array_join(F.array_sort(c), "|")
    rows = table(spark, sf, "documents").withColumn("body", body).withColumn("i", text.iocs(F.col("body")))
    return rows.select("doc_id", flat(F.col("i.cves")).alias("cves"), flat(F.col("i.ips")).alias("ips"),
                       flat(F.col("i.urls")).alias("urls"), flat(F.col("i.hashes.sha256")).alias("sha256"))


@query("canonical_url", f"SELECT page_id, {sql_canonical_url('url', vocab.TRACKING_PARAMS)} AS canonical_url FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("canonical_url_dedupe", f"SELECT page_id, {sql_canonical_url('url', vocab.DEDUPE_PARAMS)} AS canonical_url FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical_url_dedupe(F.col("url")).alias("canonical_url"))


@query("canonical_url_sample", f"SELECT page_id, {sql_canonical_url('url', vocab.SAMPLE_PARAMS, False, False)} AS canonical_url FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical_url_sample(F.col("url")).alias("canonical_url"))


@query("upgrade_known_http", """SELECT page_id, CASE WHEN starts_with(u, 'http://arxiv.org') THEN replace(u, 'http://', 'https://') ELSE u END AS url
  FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://arxiv.org/abs/' || page_id ELSE url END AS u FROM pages)""")
def _(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://arxiv.org/abs/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", urls.upgrade_http(u).alias("url"))


SQL_HOST = r"lower(regexp_extract(trim({u}), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query("url_safety", f"""
  SELECT page_id, u AS url, CASE WHEN h = '' THEN 'invalid'
    WHEN h IN ('localhost', '127.0.0.1') OR h LIKE '%.local' OR h LIKE '%.internal'
      OR regexp_matches(h, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|169\\.254\\.)') THEN 'private_ip'
    WHEN u LIKE 'https:%' THEN 'safe' ELSE 'unsafe_protocol' END AS status
  FROM (SELECT page_id, u, {SQL_HOST.format(u='u')} AS h FROM (
    SELECT page_id, CASE page_id % 10 WHEN 7 THEN 'https://192.168.0.' || (page_id % 250) || '/x' WHEN 8 THEN 'https://svc.internal/' || page_id
      WHEN 9 THEN 'no url ' || page_id ELSE url END AS u FROM pages))""")
def _(spark, sf):
    p = F.col("page_id")
    s = p.cast("string")
    u = (F.when(p % 10 == 7, F.concat(F.lit("https://192.168.0."), (p % 250).cast("string"), F.lit("/x")))
         .when(p % 10 == 8, F.concat(F.lit("https://svc.internal/"), s)).when(p % 10 == 9, F.concat(F.lit("no url "), s))
         .otherwise(F.col("url")))
    return pages(spark, sf).select("page_id", u.alias("url"), urls.url_safety_status(u).alias("status"))


@query("infer_publisher", f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Given' WHEN h = '' THEN 'Unknown' ELSE regexp_replace(h, '^www\\.', '') END AS publisher
  FROM (SELECT page_id, {SQL_HOST.format(u='url')} AS h FROM pages)""")
def _(spark, sf):
    given = F.when(F.col("page_id") % 4 == 0, F.lit(" Given "))
    return pages(spark, sf).select("page_id", urls.infer_publisher(given, F.col("url")).alias("publisher"))


HOSTS = {"ththre.example.com": "Ththre Post", "thther.example.org": "Thther Daily", "spam-farm.example.org": "Spam Farm"}


@query("lookup_publisher_domain", f"""SELECT page_id, {sql_map('h', HOSTS, 'h')} AS publisher
  FROM (SELECT page_id, regexp_replace({SQL_HOST.format(u='url')}, '^www\\.', '') AS h FROM pages)""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.lookup_publisher(F.col("url"), HOSTS).alias("publisher"))


@query("infer_date_from_url", f"""
  SELECT doc_id, CASE WHEN d >= DATE '2020-01-01' AND d <= DATE '{AS_OF[:10]}' THEN d END AS inferred
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('month', d)::DATE ELSE d END AS d
        FROM (SELECT doc_id, DATE '2018-06-01' + (doc_id % 3000)::INT AS d FROM documents))""")
def _(spark, sf):
    doc = F.col("doc_id")
    d = F.date_add(F.lit("2018-06-01").cast("date"), (doc % 3000).cast("int"))
    u = (F.when(doc % 4 == 0, F.concat(F.lit("https://a.org/"), F.date_format(d, "yyyy/MM/dd"), F.lit("/x")))
         .when(doc % 4 == 1, F.concat(F.lit("https://a.org/"), F.date_format(d, "yyyy/MM"), F.lit("/x")))
         .when(doc % 4 == 2, F.concat(F.lit("https://a.org/x-"), F.date_format(d, "yyyy-MM-dd"), F.lit(".html")))
         .otherwise(F.concat(F.lit("https://a.org/"), F.col("source"))))
    return table(spark, sf, "documents").select("doc_id", urls.infer_date(u, as_of()).alias("inferred"))


@query("source_id", f"""SELECT page_id, left(sha256({sql_canonical_url('url', vocab.TRACKING_PARAMS)}), 36) AS id FROM pages""")
def _(spark, sf):
    u = urls.canonical_url(F.col("url"))
    return pages(spark, sf).select("page_id", urls.source_id(u, F.col("page_id").cast("string")).alias("id"))


@query("normalize_source", f"""
  SELECT position, left(sha256(CASE WHEN cu <> '' THEN cu ELSE {sql_clean_plaintext('title')} || '||' || {sql_clean_plaintext('full_text')} END), 36) AS id, cu AS url, coalesce(url, '') AS original_url,
    {sql_clean_plaintext('title')} AS title, {sql_clean_plaintext('publisher')} AS publisher, date_published,
    date_published AS date_published_actual, date_confidence, source_type, trust_tier, false AS is_curated_flag,
    sha256({sql_clean_plaintext('full_text')}) AS clean_text_hash
  FROM (SELECT *, {sql_canonical_url("coalesce(url, '')", vocab.TRACKING_PARAMS)} AS cu FROM sources)""".replace(
    "false AS is_curated_flag", "trust_tier = 'curated' AS is_curated"), ["sources"])
def _(spark, sf):
    from strandline.plans.ingest import normalize_source
    rows = sources(spark, sf).withColumn("text_in", F.col("full_text"))
    return normalize_source(rows, as_of()).select(
        "position", "id", "url", "original_url", "title", "publisher", "date_published", "date_published_actual",
        "date_confidence", "source_type", "trust_tier", "is_curated", "clean_text_hash")


@query("normalize_title", r"""SELECT position, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS title
  FROM sources""", ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", text.normalize_title(F.col("title")).alias("title"))


def _sql_tokens(stop, n: int) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), "
            f"lambda x: length(x) >= {n} AND NOT list_contains({sql_list(stop)}, x)))), ' ')")


@query("title_tokens_dedupe", f"SELECT position, {_sql_tokens(vocab.DEDUPE_STOPWORDS, 3)} AS tokens FROM sources", ["sources"])
def _(spark, sf):
    t = text.title_tokens(F.col("title"), vocab.DEDUPE_STOPWORDS, 3)
    return sources(spark, sf).select("position", F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("title_tokens_cluster", f"SELECT position, {_sql_tokens(vocab.CLUSTER_STOPWORDS, 4)} AS tokens FROM sources", ["sources"])
def _(spark, sf):
    t = text.title_tokens(F.col("title"), vocab.CLUSTER_STOPWORDS, 4)
    return sources(spark, sf).select("position", F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("jaccard", """
  SELECT doc_id, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(u), 6) END AS similarity
  FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(left(text, length(text) // 2)), '[^a-z0-9]+'), lambda x: x <> '') AS a,
           list_filter(regexp_split_to_array(lower(substr(text, length(text) // 2 + 1)), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM documents))""")
def _(spark, sf):
    """The first half of each whole text against the second."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = (text.title_tokens(c, [], 1) for c in (F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))))
    return table(spark, sf, "documents").select("doc_id", F.round(rules.jaccard(first, second), 6).alias("similarity"))


@query("detect_language", r"""
  SELECT position, CASE WHEN s = '' THEN 'unknown' WHEN (length(s) - length(regexp_replace(s, '[^\x00-\x7F]', '', 'g'))) / length(s) > 0.3
    THEN 'non_english' ELSE 'en' END AS language
  FROM (SELECT position, array_to_string(list_filter([title, full_text], lambda x: x <> ''), ' ') AS s FROM sources)""", ["sources"])
def _(spark, sf):
    lang = text.detect_language(F.col("title"), F.lit(None).cast("string"), F.col("full_text"))
    return sources(spark, sf).select("position", lang.alias("language"))


@query("phrase_match", "SELECT position, " + sql_any("low", ["the", "und"]) + " AND contains(low, 'en') AND NOT " + sql_any("low", ["qui", "que"])
       + " AS hit FROM (SELECT position, lower(title || ' ' || full_text) AS low FROM sources)", ["sources"])
def _(spark, sf):
    t = rules.lower_text(F.col("title"), F.col("full_text"))
    return sources(spark, sf).select("position", rules.phrase_match(
        t, any_of=["the", "und"], required=["en"], none_of=["qui", "que"]).alias("hit"))


PHRASES = ["the", "und", "elle", "que", "ing", "tion"]


@query("phrase_count", "SELECT position, (least(" + " + ".join(f"contains(low, '{p}')::INT" for p in PHRASES) + ", 4) * 3)::INT AS points "
       "FROM (SELECT position, lower(title || ' ' || full_text) AS low FROM sources)", ["sources"])
def _(spark, sf):
    t = rules.lower_text(F.col("title"), F.col("full_text"))
    return sources(spark, sf).select("position", rules.phrase_count(t, PHRASES, 4, 3).alias("points"))


@query("word_count", r"""SELECT doc_id, CASE WHEN text = '' THEN 0
  ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END::INT AS words FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


# Percentages and years are planted with the document id, because the prose has almost none.
PLANTED = "text || ' up ' || (doc_id % 140) || '% since ' || (2015 + doc_id % 20)"


@query("find_percentages", f"""SELECT doc_id, unnest(regexp_extract_all({PLANTED}, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1)) AS percentage FROM documents""")
def _(spark, sf):
    return planted(spark, sf).select("doc_id", F.explode(text.percentages(F.col("body"))).alias("percentage"))


@query("find_years", f"""SELECT doc_id, unnest(regexp_extract_all({PLANTED}, '\\b20[0-9]{{2}}\\b'))::INT AS year FROM documents""")
def _(spark, sf):
    return planted(spark, sf).select("doc_id", F.explode(text.years(F.col("body"))).alias("year"))


def planted(spark, sf):
    doc = F.col("doc_id")
    return table(spark, sf, "documents").withColumn("body", F.concat(
        "text", F.lit(" up "), (doc % 140).cast("string"), F.lit("% since "), (doc % 20 + 2015).cast("string")))


@query("enum_score", f"SELECT position, {sql_map('trust_tier', {'primary': 10, 'high': 8, 'medium': 6}, '0')}::INT AS points FROM sources", ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", rules.lookup(F.col("trust_tier"), {"primary": 10, "high": 8, "medium": 6}, 0).alias("points"))


@query("pick_one", f"""SELECT position, CASE WHEN list_contains({sql_list(vocab.SOURCE_TYPES)}, replace(lower(source_type), '-', '_'))
  THEN replace(lower(source_type), '-', '_') ELSE 'unknown' END AS picked FROM sources""", ["sources"])
def _(spark, sf):
    shouted = F.upper(F.replace(F.col("source_type"), F.lit("_"), F.lit("-")))
    return sources(spark, sf).select("position", rules.pick_one(shouted, vocab.SOURCE_TYPES).alias("picked"))


@query("vocab_intersect", f"""SELECT position, array_to_string(list_filter(list_transform(tags, lambda x: lower(x)), lambda x: x IN ('the', 'elle', 'que')), '|') AS kept
  FROM tagged""", ["tagged"])
def _(spark, sf):
    up = F.transform("tags", F.upper)
    return tagged(spark, sf).select("position", F.array_join(rules.vocab_intersect(up, ["the", "elle", "que"]), "|").alias("kept"))


@query("array_set_ops", """SELECT position, array_to_string(list_sort(list_distinct(list_concat(list_concat(tags, list_transform(framework_tags, lambda x: x.tag)),
    list_transform(attack_mappings, lambda x: x.tag)))), '|') AS all_tags FROM understood""", ["understood"])
def _(spark, sf):
    from strandline.operators.taxonomy import all_tags
    rows = understood(spark, sf)
    return rows.select("position", F.array_join(F.array_sort(all_tags(rows)), "|").alias("all_tags"))


@query("label_format", "SELECT DISTINCT source_type, array_to_string(list_transform(string_split(source_type, '_'), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS label FROM sources",
       ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("source_type", text.label_format(F.col("source_type")).alias("label")).distinct()


@query("json_record_parse", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return events(spark, sf).select("event_id", F.coalesce(parsed["k"], F.lit(-1)).cast("bigint").alias("k"))


@query("parse_date", "SELECT event_id, date_trunc('second', ts) AS parsed_iso, date_trunc('second', ts) AS parsed_rfc, NULL::TIMESTAMP AS parsed_bad FROM events")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rfc = F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return events(spark, sf).select("event_id", times.parse_date(iso).alias("parsed_iso"), times.parse_date(rfc).alias("parsed_rfc"),
                                    times.parse_date(F.col("event_type")).alias("parsed_bad"))


@query("schema_check", f"""
  SELECT position, array_to_string(list_filter([
    CASE WHEN url IS NULL THEN 'url: required field missing' END,
    CASE WHEN NOT list_contains({sql_list(vocab.ALL_SOURCE_TYPES)}, source_type) THEN 'source_type: "' || source_type || '" not in enum [{",".join(vocab.ALL_SOURCE_TYPES[:5])}...]' END],
    lambda x: x IS NOT NULL), '; ') AS issues FROM sources""", ["sources"])
def _(spark, sf):
    return classify.schema_check(sources(spark, sf), classify.RAW_FIELDS).select("position", F.array_join("issues", "; ").alias("issues"))


# --- dates ---------------------------------------------------------------------
@query("year_month", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def _(spark, sf):
    return events(spark, sf).select("event_id", times.year_month(F.col("ts")).alias("month"))


@query("format_local_date", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%d %b %Y, %H:%M') AS shown FROM events")
def _(spark, sf):
    return events(spark, sf).select("event_id", times.format_local(F.col("ts")).alias("shown"))


@query("daily_window", """
  SELECT event_type, d - INTERVAL 2 HOUR AS start_utc, d + INTERVAL 22 HOUR AS end_utc, count(*) AS events
  FROM (SELECT *, date_trunc('day', ts + INTERVAL 2 HOUR) AS d FROM events) GROUP BY event_type, d""".replace(
    "d - INTERVAL 2 HOUR", "d - INTERVAL 2 HOUR"))
def _(spark, sf):
    return (events(spark, sf).groupBy("event_type", times.day_bucket(F.col("ts")).alias("w"))
            .agg(F.count("*").alias("events")).select("event_type", F.col("w.start").alias("start_utc"),
                                                      F.col("w.end").alias("end_utc"), "events"))


SQL_END = "(date_trunc('day', ts + INTERVAL 2 HOUR) - INTERVAL 2 HOUR)"


@query("period_window", f"""SELECT event_id, {SQL_END} - INTERVAL 1 DAY AS daily_start, {SQL_END} - INTERVAL 7 DAY AS weekly_start,
  {SQL_END} - INTERVAL 30 DAY AS monthly_start, {SQL_END} - INTERVAL 90 DAY AS quarterly_start, {SQL_END} AS end_utc FROM events""")
def _(spark, sf):
    """The reporting periods as seen at each event's time."""
    ts = F.col("ts")
    return events(spark, sf).select("event_id", *[
        times.period_window(ts, p)["start_utc"].alias(f"{p}_start") for p in times.PERIOD_DAYS],
        times.daily_window(ts)["end_utc"].alias("end_utc"))


@query("iso_week_key", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%G-W%V') AS week FROM events")
def _(spark, sf):
    return events(spark, sf).select("event_id", times.iso_week_key(F.col("ts")).alias("week"))


@query("iso_week_window", """
  SELECT event_id, strftime(m, '%G-W%V') AS week_key, m - INTERVAL 8 HOUR AS start_utc, ts AS end_utc, false AS is_complete,
         m - INTERVAL 176 HOUR AS previous_start, m - INTERVAL 8 HOUR AS previous_end, true AS previous_complete
  FROM (SELECT *, date_trunc('week', ts + INTERVAL 8 HOUR)::TIMESTAMP AS m FROM events)""")
def _(spark, sf):
    now = times.iso_week_window(F.col("ts"))
    prev = times.iso_week_window(F.col("ts"), -1)
    return events(spark, sf).select(
        "event_id", now["week_key"].alias("week_key"), now["start_utc"].alias("start_utc"), now["end_utc"].alias("end_utc"),
        now["is_complete"].alias("is_complete"), prev["start_utc"].alias("previous_start"),
        prev["end_utc"].alias("previous_end"), prev["is_complete"].alias("previous_complete"))


@query("year_window", "SELECT event_id, ts - INTERVAL 12 MONTH AS start_utc, ts AS end_utc FROM events")
def _(spark, sf):
    w = times.year_window(F.col("ts"))
    return events(spark, sf).select("event_id", w["start_utc"].alias("start_utc"), w["end_utc"].alias("end_utc"))


@query("in_window", "SELECT event_id, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' AS inside FROM events")
def _(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-17"))
    return events(spark, sf).select("event_id", times.in_window(F.col("ts"), lo, hi).alias("inside"))


@query("within_days", f"SELECT position, coalesce(date_published > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY, false) AS recent FROM sources", ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", times.within_days(F.col("date_published"), 90, as_of()).alias("recent"))


@query("day_windows", """
  SELECT event_type, day::DATE AS day, day - INTERVAL 8 HOUR AS start_utc, day + INTERVAL 16 HOUR AS end_utc
  FROM (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day
        FROM (SELECT event_type, min(ts)::DATE::TIMESTAMP AS lo, max(ts)::DATE::TIMESTAMP AS hi FROM events GROUP BY event_type))""")
def _(spark, sf):
    spans = events(spark, sf).groupBy("event_type").agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return times.day_windows(spans, "lo", "hi").select("event_type", "day", "start_utc", "end_utc")


@query("week_chunks", """
  SELECT event_type, c AS chunk_start, least(c + INTERVAL 7 DAY, hi) AS chunk_end
  FROM (SELECT event_type, hi, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS c
        FROM (SELECT event_type, date_trunc('day', min(ts)) AS lo, date_trunc('second', max(ts)) AS hi FROM events GROUP BY event_type)) WHERE c < hi""")
def _(spark, sf):
    spans = events(spark, sf).groupBy("event_type").agg(times.trunc("day", F.min("ts")).alias("lo"), times.trunc("second", F.max("ts")).alias("hi"))
    return times.week_chunks(spans, "lo", "hi").select("event_type", "chunk_start", "chunk_end")


@query("snapshot_key", "SELECT event_id, 'snapshot-' || strftime(ts + INTERVAL 26 HOUR, '%Y-%m-%d') AS snapshot_id FROM events")
def _(spark, sf):
    return events(spark, sf).select("event_id", times.snapshot_key(F.col("ts")).alias("snapshot_id"))


SQL_AGE = (f"CASE WHEN date_published IS NULL THEN 0 WHEN date_published >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 5 "
           f"WHEN date_published >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 3 WHEN date_published >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY THEN 2 "
           f"WHEN date_published >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN 1 ELSE 0 END")


@query("age_band", f"SELECT position, {SQL_AGE}::INT AS points FROM sources", ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", times.age_band(F.col("date_published"), as_of()).alias("points"))
