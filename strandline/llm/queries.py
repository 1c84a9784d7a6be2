"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import ann, bpe, chatformat, decontam, licenses, linededup, negatives, pii, prefixtrie, quality, reshard, simhash, warc
from strandline.llm.common import cut_lineage, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers
    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), **tokenizer_paths(), digests=True)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "matched", "coverage", "kind")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    named = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_distinct(F.transform("licenses", lambda x: x["license"])), ",").alias("licenses"),
                        F.array_join(named, ",").alias("spans"), F.array_join("sentences", ",").alias("sentence_ids"))


@query("op9_lines", linededup.ORACLE)
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return linededup.remove_boilerplate(docs, removed="n_removed")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query("op7_reshard")
def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard.reshard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query("op3_ann")
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op5_warc", """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html)
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html)
            THEN max(page_id) OVER (PARTITION BY html) END AS refers_to
FROM pages
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_hard_negatives", """
WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
positive AS (
    SELECT anchor, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(negatives.usable("embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ints = rows.select("vec_id", moved.alias("label"), negatives.quantised("embedding").alias("embedding"))
    return negatives.mine(ints, F.col("vec_id") % 100 == 0)


@query("op12_prefix_trie", """
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL),
k AS (
    SELECT c, count(*) AS n, c - c % 20 AS base,
           (xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
                            lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 4)::BIGINT AS h
    FROM t GROUP BY c),
m AS (SELECT k.c, k.base, k.h, least(k.h, coalesce(b.n, 0)) AS m FROM k LEFT JOIN k b ON b.c = k.base),
s AS (
    SELECT m.c, t.p, t.r, t.x FROM m JOIN t ON t.c = m.base AND t.p <= m.m
    UNION ALL SELECT m.c, t.p - m.h + m.m, t.r, t.x FROM m JOIN t ON t.c = m.c AND t.p > m.h),
d AS (
    SELECT c, p, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w,
           sha256(string_agg(len(r) || ':' || r || len(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY p)) AS k FROM s
    UNION ALL SELECT c, 0, 0, '' FROM k),
node AS (SELECT p, k, min(c) AS c, count(*) AS n, any_value(w) AS w FROM d GROUP BY p, k),
up AS (SELECT DISTINCT d.p, d.k, e.k AS pk FROM d JOIN d e ON e.c = d.c AND e.p = d.p - 1),
kids AS (SELECT p - 1 AS p, pk AS k, count(*) AS n FROM up GROUP BY ALL),
pair AS (SELECT DISTINCT d.p, d.k, e.p AS ep, e.k AS ek FROM d JOIN d e ON e.c = d.c AND e.p >= d.p),
sums AS (
    SELECT pair.p, pair.k, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((y.n - 1) * y.w) AS saved
    FROM pair JOIN node y ON y.p = pair.ep AND y.k = pair.ek LEFT JOIN kids ON kids.p = y.p AND kids.k = y.k GROUP BY ALL),
ends AS (
    SELECT p, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM (SELECT * FROM d QUALIFY p = max(p) OVER (PARTITION BY c)) GROUP BY p, k)
SELECT x.c AS conv_id, x.p::BIGINT AS depth, y.c AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sums.n_leaves::BIGINT AS n_leaves,
       sums.saved::BIGINT AS saved_tokens, coalesce(ends.e, sha256('')) AS ends_sha256
FROM node x JOIN sums USING (p, k) LEFT JOIN kids USING (p, k) LEFT JOIN ends USING (p, k)
     LEFT JOIN up USING (p, k) LEFT JOIN node y ON y.p = x.p - 1 AND y.k = up.pk
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut_lineage(prefixtrie.numbered_turns(table(spark, sf_dir, "conversations")), "trie-turns")
    rebuilt, convs = prefixtrie.spliced(turns)
    return prefixtrie.trie(cut_lineage(rebuilt, "trie-rebuilt"), convs)


def _formatted_chars() -> str:
    """SQL for the length of one formatted turn of role r and text x: marks, placeholders and escapes."""
    escapes = "len(regexp_extract_all({}, '" + chatformat.CONTROL + "'))"
    plain = f"regexp_replace(x, '{chatformat.MARKUP}', chr(1), 'g')"
    places = " + ".join(f"{len(kind) + 4} * len(regexp_extract_all(x, '{chatformat.markup(ends)}'))" for kind, ends in chatformat.ENDINGS.items())
    any_place = f"len(regexp_extract_all(x, '{chatformat.MARKUP}'))"
    return f"23 + length(r) + {escapes.format('r')} + length({plain}) - {any_place} + {places} + {escapes.format(plain)}"


@query("op13_chat_format", f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum({_formatted_chars()})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""")
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = said.unionByName(added).select("conv_id", "turn", "role", chatformat.text_parts(F.col("text")).alias("parts"))
    back = chatformat.read_back(chatformat.format_chats(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
