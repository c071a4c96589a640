"""Text queries: codes, tags, tokens, retrieval, the cascade, chunks, recovered JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.functions import codes, extract, recover
from casegrid.plans.registry import Registry
from casegrid.session import table
from casegrid.sources import readers

R = Registry()


@R.add("t2_inline_codes", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)version[ \t\n:]+([0-9]{1,9})', 1), ',') AS versions, len(regexp_extract_all(text, '[0-9]{6,9}'))::INTEGER AS long_numbers FROM documents""")
def t2(spark: SparkSession, d: str) -> DataFrame:
    """Labelled codes and bare numbers, in order."""
    versions = F.regexp_extract_all("text", F.lit(r"(?i)version[ \t\n:]+([0-9]{1,9})"), F.lit(1))
    numbers = F.regexp_extract_all("text", F.lit("[0-9]{6,9}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.array_join(versions, ",").alias("versions"), F.size(numbers).alias("long_numbers"))


@R.add("t20_normal_codes", r"""
WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Pertussis (SNOMED ' || (event_id + 27836007) || ')' WHEN 1 THEN 'LOINC ' || event_id || '-3' WHEN 2 THEN (user_id + 10000)::VARCHAR ELSE 'null' END AS raw FROM events)
SELECT event_id, CASE WHEN lower(raw) = 'null' THEN NULL WHEN regexp_full_match(raw, '[0-9]+') THEN raw ELSE nullif(regexp_extract(raw, '\b([0-9]{5,18})\b', 1), '') END AS condition,
 CASE WHEN lower(raw) = 'null' THEN NULL ELSE coalesce(nullif(regexp_extract(raw, '\b[0-9]{1,7}-[0-9]\b'), ''), CASE WHEN regexp_full_match(raw, '[A-Za-z0-9.-]+') AND regexp_matches(raw, '[0-9]') THEN raw END) END AS loinc FROM v""")
def t20(spark: SparkSession, d: str) -> DataFrame:
    """Raw codes out of values with display text."""
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit("Pertussis (SNOMED "), (F.col("event_id") + 27836007).cast("string"), F.lit(")"))).when(n == 1, F.concat(F.lit("LOINC "), F.col("event_id").cast("string"), F.lit("-3"))).when(n == 2, (F.col("user_id") + 10000).cast("string")).otherwise("null")
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", codes.normal_code("conditions", F.col("raw")).alias("condition"), codes.normal_code("loincs", F.col("raw")).alias("loinc"))


@R.add("t6_tag_attributes", r"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a\b[^>]*>'), lambda t: regexp_extract(t, 'href\s*=\s*"([^"]*)"', 1)), ' ') AS hrefs,
       regexp_extract(html, '<html[^>]*lang\s*=\s*"([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<p\b[^>]*>'))::INTEGER AS paragraphs FROM pages""")
def t6(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of tags, whatever their order."""
    hrefs = F.transform(codes.tags(F.col("html"), "a"), lambda t: F.coalesce(codes.tag_attribute(t, "href"), F.lit("")))
    lang = F.coalesce(codes.tag_attribute(F.get(codes.tags(F.col("html"), "html"), F.lit(0)), "lang"), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.array_join(hrefs, " ").alias("hrefs"), lang.alias("lang"), F.size(codes.tags(F.col("html"), "p")).alias("paragraphs"))


@R.add("s9_format_sniff", """
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'MSH|^~|' || text WHEN 1 THEN ' {"resourceType":"Bundle"}' ELSE text END AS body, CASE WHEN doc_id % 5 = 0 THEN 'CDA' END AS hint FROM documents)
SELECT doc_id, CASE WHEN hint = 'CDA' THEN 'eicr' WHEN ltrim(body) LIKE 'MSH|%' THEN 'hl7' WHEN ltrim(body) LIKE '{%' AND contains(body, '"resourceType"') THEN 'fhir' ELSE 'eicr' END AS format FROM t""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Format from a hint or from the first characters."""
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("MSH|^~|"), "text")).when(F.col("doc_id") % 3 == 1, ' {"resourceType":"Bundle"}').otherwise(F.col("text"))
    hint = F.when(F.col("doc_id") % 5 == 0, "CDA")
    return table(spark, d, "documents").select("doc_id", readers.format_hint(hint, body).alias("format"))


@R.add("t17_token_sets", r"SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+'))), ' ') AS tokens FROM benchmark")
def t17(spark: SparkSession, d: str) -> DataFrame:
    """Token sets (ASCII class, so that both engines agree)."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9-]+"), F.lit(0))))
    return table(spark, d, "benchmark").select("item_id", F.array_join(found, " ").alias("tokens"))


@R.add("t18_retrieve_topk", r"""
WITH q AS (SELECT doc_id, len(t) AS n, t FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+')) AS t FROM documents)),
k AS (SELECT item_id, len(t) AS m, t FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+')) AS t FROM benchmark)),
qt AS (SELECT doc_id, n, unnest(t) AS w FROM q), kt AS (SELECT item_id, m, unnest(t) AS w FROM k),
s AS (SELECT doc_id, item_id, count(*) / (n + m) + 0.1 * sum((length(w) >= 6)::INT) AS score FROM qt JOIN kt USING (w) GROUP BY doc_id, item_id, n, m)
SELECT doc_id, item_id, round(score, 6) AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS r FROM s) WHERE r <= 3 AND score >= 0.2""")
def t18(spark: SparkSession, d: str) -> DataFrame:
    """Token part of the retrieval score over all texts, top three items each: one narrow pass against an index of the items, whose number is checked."""
    got = extract.token_scores(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "[a-z0-9][a-z0-9-]+")
    return got.select("doc_id", "item_id", F.round("score", 6).alias("score"), "rank")


#: The lexicon and knowledge base of the cascade query: words that the driver's documents hold.
TERMS = [
    extract.Term("snomed", "100001", ("GNU General Public License", "Apache License", "MIT License")),
    extract.Term("snomed", "100002", ("pathetic loser", "disgusting", "stupid", "scum")),
    extract.Term("loinc", "1000-3", ("email", "phone")),
    extract.Term("rxnorm", "2001", ("token", "password", "api_key", "secret")),
]
ENTRIES = [
    extract.Entry("200001", "SNOMED", "the of and", ("THE",), "list", "common"),
    extract.Entry("200002", "SNOMED", "der die und", (), "list", "common"),
]


@R.add("t15_cascade")
def t15(spark: SparkSession, d: str) -> DataFrame:
    """The tiered extraction over whole texts, in long form (checked by unit tests)."""
    return extract.extract(table(spark, d, "documents"), TERMS, ENTRIES)


@R.add("j13_search")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Full retrieval score (phrases, tokens, long tokens) of the knowledge base for every text."""
    return extract.search_all(table(spark, d, "documents"), ENTRIES, "doc_id", "text")


@R.add("t22_chunks")
def t22(spark: SparkSession, d: str) -> DataFrame:
    """Lossless chunks with their token estimate (checked by a round trip)."""
    return extract.chunk(table(spark, d, "documents"))


@R.add("t22_chunk_totals", "SELECT doc_id, length(text)::BIGINT AS n_chars, floor(length(text) / 3.5)::INTEGER AS token_estimate FROM documents")
def t22_totals(spark: SparkSession, d: str) -> DataFrame:
    """Chunks sum up to their text."""
    parts = extract.chunk(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("n_chars"))
    return parts.select("doc_id", "n_chars", F.floor(F.col("n_chars") / F.lit(3.5)).cast("int").alias("token_estimate"))


@R.add("t24_json_recover", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT)::BIGINT AS k FROM events""")
def t24(spark: SparkSession, d: str) -> DataFrame:
    """Objects recovered from fenced, wrapped and cut-off output."""
    n = F.col("event_id") % 3
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    rows = table(spark, d, "events").select("event_id", recover.recover(raw).alias("json"))
    return rows.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"))


@R.add("s8_json_scan", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Variant paths, null where absent."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@R.add("t38_validate_rows", """
SELECT event_id, array_to_string(list_filter([CASE WHEN NOT contains(props, '"k"') THEN 'missing k' END, CASE WHEN NOT contains(props, '"loincs"') THEN 'missing loincs' END, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'large k' END], lambda x: x IS NOT NULL), '; ') AS issues FROM events""")
def t38(spark: SparkSession, d: str) -> DataFrame:
    """List of issues of an extraction."""
    k = F.get_json_object("props", "$.k").cast("long")
    issues = F.array_compact(F.array(F.when(k.isNull(), "missing k"), F.when(F.get_json_object("props", "$.loincs").isNull(), "missing loincs"), F.when(k > 50, "large k")))
    return table(spark, d, "events").select("event_id", F.array_join(issues, "; ").alias("issues"))


@R.add("t28_split_names", r"""
SELECT s_suppkey, split_part(s_name, '#', 1) AS given, CASE WHEN contains(s_name, '#') THEN substr(s_name, instr(s_name, '#') + 1) ELSE '' END AS family,
 'Town' AS city, 'ST' AS state, s_nationkey::VARCHAR AS zip, 'Name ' || s_suppkey AS name, (1000 + s_suppkey)::VARCHAR AS code FROM supplier""")
def t28(spark: SparkSession, d: str) -> DataFrame:
    """Names, addresses and coded names split."""
    who = codes.person(F.regexp_replace("s_name", "#", " "))
    where = codes.place(F.concat(F.lit("Town, ST "), F.col("s_nationkey").cast("string")))
    coded = codes.name_and_code(F.concat(F.lit("Name "), F.col("s_suppkey").cast("string"), F.lit(" (SNOMED "), (F.col("s_suppkey") + 1000).cast("string"), F.lit(")")))
    return table(spark, d, "supplier").select("s_suppkey", who["given"].alias("given"), who["family"].alias("family"), where["city"].alias("city"), where["state"].alias("state"), where["zip"].alias("zip"), coded["name"].alias("name"), coded["code"].alias("code"))


@R.add("t36_hybrid_policy", """
WITH v AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE value > 95)) AS own, list_sort(list(DISTINCT event_type) FILTER (WHERE value > 90)) AS other FROM events GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN len(coalesce(own, [])) = 0 THEN coalesce(other, []) ELSE own END, ',') AS if_empty,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(other, [])))), ',') AS always_merge FROM v""")
def t36(spark: SparkSession, d: str) -> DataFrame:
    """Merge policies."""
    v = table(spark, d, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("value") > 95, F.col("event_type")))).alias("own"), F.array_sort(F.collect_set(F.when(F.col("value") > 90, F.col("event_type")))).alias("other")
    )
    merged = F.array_sort(F.array_distinct(F.concat("own", "other")))
    return v.select("user_id", F.array_join(F.when(F.size("own") == 0, F.col("other")).otherwise(F.col("own")), ",").alias("if_empty"), F.array_join(merged, ",").alias("always_merge"))
