"""The corpus operators applied to the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import bpe_count, crosspolytope, divergence, fixity, mixing, nbest, periodic, quality, simhash, splitters, stream_dedup, template, toolcalls
from dosewise.llm.common import table
from dosewise.queries.registry import query


@query()
def op5_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
""")
def op9_streaming_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = stream_dedup.deduplicate(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op10_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op7_mix_to_target_weights(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(table(spark, sf, "documents")).counts()


@query()
def op3_nbest_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """The best segmentation of every document by its length and the hash of its ids, the next ones as edits of it."""
    found = nbest.encode(table(spark, sf, "documents"))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_xxh64"), "others", "decoded")


def _hex_sql(digest: str, digits: int) -> str:
    return f"CAST('0x' || substr({digest}, 1, {digits}) AS BIGINT)"


# The checksum is worked out byte by byte from its table; all else follows the sampled splitters step by step.
@query(f"""
WITH t AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS v FROM range(256) r(n)),
r AS (
  SELECT doc_id AS id, md5(coalesce(text, '')) AS key, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM documents, t),
a AS (SELECT CAST(sum(size) AS BIGINT) AS total, greatest(1.0, sum(size) / (24 * 64 * 12)) AS step FROM r),
s AS (
  SELECT key, id, greatest(size, CAST(ceil(step) AS BIGINT)) AS w FROM r, a
  WHERE {_hex_sql("md5(concat_ws('|', 'draw', coalesce(CAST(id AS VARCHAR), ''), key))", 12)} < least(size / step, 1.0) * 281474976710656.0),
u AS (SELECT *, CAST(sum(w) OVER (ORDER BY key, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(w) OVER () AS BIGINT) / 1536 AS share FROM s),
b AS (SELECT DISTINCT key FROM u WHERE floor(upto / share) > floor((upto - w) / share)),
p AS (SELECT *, 2 * (SELECT count(*) FROM b WHERE b.key < r.key) + (SELECT count(*) FROM b WHERE b.key = r.key) AS piece FROM r),
h AS (SELECT piece, CAST(ceil(sum(size) / any_value(most)) AS BIGINT) AS parts FROM p, (SELECT greatest(1.0, total / 1536 * 4) AS most FROM a) GROUP BY piece HAVING sum(size) > any_value(most)),
q AS (SELECT p.*, coalesce({_hex_sql("md5(concat_ws('|', 'part', coalesce(CAST(id AS VARCHAR), '')))", 12)} % parts, 0) AS part FROM p LEFT JOIN h USING (piece)),
c AS (SELECT piece, part, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM q GROUP BY piece, part),
g AS (
  SELECT piece, part, n, CAST(least(floor((coalesce(sum(bytes) OVER (ORDER BY piece, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + bytes / 2) * 24 / total), 23) AS INTEGER) AS shard
  FROM c, a),
o AS (SELECT piece, part, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY piece, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT id AS doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(before + row_number() OVER (PARTITION BY piece, part ORDER BY key, id, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM q JOIN o USING (piece, part)
""")
def op4_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    return splitters.shard_documents(table(spark, sf, "documents"))


@query()
def op6_cross_polytope_search(spark: SparkSession, sf: str) -> DataFrame:
    return crosspolytope.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


# The given pages keep their text in one article of headings and paragraphs, so a plain cut at these tags reads it.
@query("""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS body FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS blocks
  FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t
""")
def op8_site_template_removal(spark: SparkSession, sf: str) -> DataFrame:
    return template.extract(table(spark, sf, "pages"))


# Records of the second replica in the audit: some are altered in one character, some are lost.
ALTERED, LOST = "page_id % 97 = 5", "page_id % 211 = 7"


@query(f"""
WITH p AS (
  SELECT 'part-' || CAST(page_id // 512 AS VARCHAR) AS file, page_id AS record, coalesce(url, '') || chr(10) || coalesce(html, '') AS body,
    coalesce(url, '') || chr(10) || CASE WHEN {ALTERED} THEN coalesce(html, '') || '.' ELSE coalesce(html, '') END AS copy, {LOST} AS lost
  FROM pages),
r AS (
  SELECT file, record, CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY file ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at",
    sha256(body) AS hash, CASE WHEN NOT lost THEN sha256(copy) END AS other
  FROM p),
n0 AS (
  SELECT file, "at" // 65536 AS node, count(*) AS records, count(other) AS records_b,
    sha256(string_agg("at" || ':' || hash, ',' ORDER BY "at")) AS hash, sha256(string_agg("at" || ':' || other, ',' ORDER BY "at") FILTER (other IS NOT NULL)) AS other
  FROM r GROUP BY ALL),
""" + "".join(f"""n{k} AS (
  SELECT file, node // 16 AS node, sum(records) AS records, sum(records_b) AS records_b,
    sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash, sha256(string_agg(node || ':' || other, ',' ORDER BY node) FILTER (other IS NOT NULL)) AS other
  FROM n{k - 1} GROUP BY file, node // 16),
""" for k in (1, 2, 3)) + """
roots AS (
  SELECT 'root' AS kind, file, CAST(node * 65536 * 4096 AS BIGINT) AS "at", CAST(NULL AS VARCHAR) AS record,
    CASE WHEN other IS NULL THEN 'missing' WHEN hash <> other THEN 'altered' ELSE 'equal' END AS verdict, hash, other, CAST(records AS BIGINT) AS records
  FROM n3)
SELECT * FROM roots UNION ALL
SELECT 'record', file, "at", CAST(record AS VARCHAR), CASE WHEN other IS NULL THEN 'missing' ELSE 'altered' END, hash, other, 1
FROM r WHERE hash IS DISTINCT FROM other
""")
def op1_merkle_fixity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit of the pages, packed into archives, against a replica in which some records are altered and some lost."""
    pages = table(spark, sf, "pages")
    html = F.coalesce("html", F.lit(""))
    altered = F.when(F.expr(ALTERED), F.concat(html, F.lit("."))).otherwise(html)
    replica = fixity.page_records(pages, change=altered).where(f"record is null or not ({LOST.replace('page_id', 'record')})")
    return fixity.audit(fixity.page_records(pages), replica)


@query("""
WITH RECURSIVE c AS (
  SELECT 'call-' || conv_id || '-' || turn AS call_id, conv_id, turn, CASE role WHEN 'system' THEN 'configure' ELSE 'ask' END AS name, text,
    CASE WHEN role = 'user' AND turn // 2 > 0 THEN 'call-' || conv_id || '-' || (turn - 2 * (turn // 2 - (turn // 2 - 1) // 2))
      WHEN role = 'user' AND turn = 1 THEN 'call-' || conv_id || '-0' END AS needs_id
  FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT 'call-' || conv_id || '-' || (turn - 1) AS r_id, conv_id AS r_conv, turn AS r_turn, text AS content FROM conversations WHERE role = 'assistant'),
e AS (SELECT call_id, needs_id, needs_id IN (SELECT call_id FROM c) AS known FROM c WHERE needs_id IS NOT NULL),
l AS (
  SELECT call_id, 0 AS level FROM c WHERE call_id NOT IN (SELECT call_id FROM e WHERE known)
  UNION ALL SELECT e.call_id, l.level + 1 FROM e JOIN l ON e.needs_id = l.call_id),
j AS (
  SELECT coalesce(c.call_id, r.r_id) AS call_id, coalesce(conv_id, r_conv) AS conv_id, coalesce(turn, r_turn) AS turn, name, level, CASE WHEN r_id IS NULL THEN 0 ELSE 1 END AS n_results,
    c.call_id IS NOT NULL AS called, text, content, c.needs_id, known
  FROM c FULL JOIN r ON c.call_id = r.r_id LEFT JOIN l ON c.call_id = l.call_id LEFT JOIN e ON c.call_id = e.call_id)
SELECT CASE WHEN called THEN 'call' ELSE 'result' END AS kind, call_id, conv_id, turn, name, level, CAST(n_results AS BIGINT) AS n_results,
  concat_ws('; ',
    CASE WHEN called AND length(text) NOT BETWEEN 1 AND 400 THEN 'out of range chars' WHEN called AND text IS NULL THEN 'wrong type chars' END,
    CASE WHEN called AND length(text) NOT BETWEEN 1 AND 400 THEN 'out of range text' WHEN called AND text IS NULL THEN 'wrong type text' END,
    CASE WHEN NOT called THEN 'result without call' END, CASE WHEN called AND n_results = 0 THEN 'no result' END,
    CASE WHEN NOT known THEN 'unknown need' END) AS problems,
  '{"arguments":' || CASE WHEN called THEN '{"chars":' || coalesce(CAST(length(text) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null')
    || ',"turn":' || turn || '}' ELSE 'null' END || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || coalesce('"' || name || '"', 'null')
    || ',"needs":[' || coalesce('"' || needs_id || '"', '') || '],"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical,
  row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) - 1 AS position
FROM j
""")
def op2_tool_call_linking(spark: SparkSession, sf: str) -> DataFrame:
    """Tool use read from the conversations: linked, ordered, validated and written as canonical JSON."""
    calls, results, needs = toolcalls.conversation_calls(table(spark, sf, "conversations"))
    schemas = spark.createDataFrame(toolcalls.CONVERSATION_TOOLS, toolcalls.TOOL_SCHEMA)
    return toolcalls.link(calls, results, needs, schemas).withColumn("problems", F.array_join("problems", "; "))


# The language's kept terms, then shares in exact integers; sums over all kept terms by the terms of either source.
@query("""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (
  SELECT g.lang, g.source, (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (
  SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (z.total + 5 * z.v) AS p
  FROM z JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
l AS (SELECT lang, sum(total) AS total, any_value(v) AS v FROM z GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(l.total) + 5 * any_value(l.v)) AS q FROM p JOIN l USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""")
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


@query()
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf, "documents"))


@query()
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the documents, of which every tenth is made periodic; the runs and the collapsed text as digests."""
    found = periodic.detect(table(spark, sf, "documents"), change=periodic.planted)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
