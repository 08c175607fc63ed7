"""Queries of the library's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import classify, commands, network
from ridgeline.functions.mentions import best_rules, mentions
from ridgeline.operators import blocks, graph, merge, reports, search, sessions, topology
from ridgeline.operators.index import Index
from ridgeline.operators.ordering import numbered
from ridgeline.plans import program
from ridgeline.session import checkpoint_dir, cut, table
from ridgeline.sources.store import Duplicate, Store
from ridgeline.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(c: Column) -> Column:
    return F.round(c, 6)


# Line programs.

BLANK_SQL = r"[\s\x0b\x{85}\p{Z}]"
WORDS_SQL = f"list_filter(regexp_split_to_array(line, '{BLANK_SQL}+'), lambda w: w <> '')"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, {WORDS_SQL} AS w, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS row_no FROM l WHERE len({WORDS_SQL}) > 0 AND NOT regexp_matches(line, '^[A-Z]+$'))
SELECT doc_id, row_no, coalesce(w[1], '') AS first, coalesce(w[2], '') AS second, array_to_string(w[3:], ' ') AS rest FROM k""")
def dsl_table_split(spark: SparkSession, d: str) -> DataFrame:
    return program.run(table(spark, d, "documents"), "# words of every line\nSKIP_BLANK\nREJECT ^[A-Z]+$\nSPLIT $first $second $rest", "text", ["doc_id"])


@query("""
WITH m AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_matches(html, '<title>([^<]*)</title>') AS a,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS l, regexp_matches(html, '<html lang="([a-z]+)"') AS b FROM pages)
SELECT page_id, CAST(0 AS INTEGER) AS row_no, CASE WHEN a THEN t END AS title, CASE WHEN b THEN l END AS lang, CASE WHEN a THEN t ELSE '' END || ' [' || CASE WHEN b THEN l ELSE '' END || ']' AS label FROM m""")
def dsl_regex_record(spark: SparkSession, d: str) -> DataFrame:
    return program.run(table(spark, d, "pages"), 'REGEX <title>(?P<title>[^<]*)</title>\nREGEX <html lang="(?P<lang>[a-z]+)"\nSET $label $title " [" $lang "]"', "html", ["page_id"])


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line FROM l WHERE regexp_matches(line, '(?i)licen[sc]e') AND regexp_matches(line, '(\w+) under (?:the )?(.*)$'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS row_no, regexp_extract(line, '(\w+) under (?:the )?(.*)$', 1) AS how, regexp_extract(line, '(\w+) under (?:the )?(.*)$', 2) AS what FROM k""")
def dsl_regex_table(spark: SparkSession, d: str) -> DataFrame:
    return program.run(table(spark, d, "documents"), r"FILTER (?i)licen[sc]e" + "\n" + r"REGEX (?P<how>\w+) under (?:the )?(?P<what>.*)$", "text", ["doc_id"])


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS url FROM pages)
SELECT page_id, CAST(0 AS INTEGER) AS row_no, url, CASE WHEN regexp_matches(url, '^https:') THEN 'secure' ELSE 'plain' END AS kind, CASE WHEN url = '' THEN 'none' ELSE url END || '!' AS mark FROM u WHERE url <> ''""")
def dsl_replace_set(spark: SparkSession, d: str) -> DataFrame:
    text = 'REPLACE "[?#].*$" ""\nREPLACE "/$" ""\nSPLIT $url\nSET $kind (REGEX_MATCH($url, "^https:") ? "secure" : "plain")\nSET $mark $url "!"'
    return program.run(table(spark, d, "pages"), text, "url", ["page_id"])


@query(f"""
WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
k AS (SELECT conv_id, turn, role, pos, line, {WORDS_SQL} AS w FROM l WHERE len({WORDS_SQL}) > 0)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS INTEGER) AS row_no, CAST(turn AS VARCHAR) AS turn, role, w[1] AS word, array_to_string(w[2:], ' ') AS rest FROM k""")
def dsl_repeat_for(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("part", F.concat(F.lit("@@"), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("raw"))
    return program.run(whole, "REPEAT_FOR ^@@(?P<turn>\\d+) (?P<role>\\w+)$\nSPLIT $word $rest", "raw", ["conv_id"])


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
a AS (SELECT doc_id, line AS ends, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE regexp_matches(line, '[.]$')),
b AS (SELECT doc_id, line AS begins, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE regexp_matches(line, '^[ET]'))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(coalesce(a.i, b.i) AS INTEGER) AS row_no, regexp_extract(ends, '^(.)', 1) AS ends, regexp_extract(begins, '(.)$', 1) AS begins FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i""")
def dsl_section_join(spark: SparkSession, d: str) -> DataFrame:
    # The lines' first and last characters are compared, as words of a line would be.
    rows = program.run(table(spark, d, "documents"), 'SECTION\nFILTER [.]$\nREPLACE "^(.).*$" "$1"\nREPLACE "^[ \t ]$" "_"\nSPLIT $ends\nSECTION\nFILTER ^[ET]\nREPLACE "^.*(.)$" "$1"\nSPLIT $begins', "text", ["doc_id"])
    return rows


# Logs and commands.


@query("""
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM events""")
def log_sessionize(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "session_no")


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return sessions.carried(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "last_purchase").select("user_id", "event_id", "last_purchase")


URL_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '/$', '')"


@query(f"SELECT page_id, {URL_SQL} AS url FROM pages")
def normalise_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", _plain_url().alias("url"))


def _plain_url() -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("url"), "^[a-z]+://", ""), r"[?#].*$", ""), "/$", "")


@query(f"""
SELECT page_id, array_to_string(list_transform(string_split({URL_SQL}, '/'), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '{{id}}' ELSE w END), ' ') AS pattern FROM pages""")
def strip_args(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", commands.strip_args(F.array_join(F.split(_plain_url(), "/"), " ")).alias("pattern"))


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promoted' WHEN p_type LIKE 'STANDARD%' THEN 'plain' WHEN p_type LIKE 'S%' THEN 'small' WHEN p_type LIKE 'E%' THEN 'eco' ELSE 'unknown' END AS kind FROM part""")
def classify_prefix(spark: SparkSession, d: str) -> DataFrame:
    rules = [("PROMO", "promoted"), ("STANDARD", "plain"), ("S", "small"), ("E", "eco")]
    return table(spark, d, "part").select("p_partkey", classify.by_prefix(F.col("p_type"), rules).alias("kind"))


LPM_SQL = "(VALUES ('', 'any', 0), ('S', 's', 0), ('STANDARD', 'standard', 0), ('PROMO', 'promo', 0), ('P', 'first', 5), ('e', 'e', 0)) AS r(prefix, kind, priority)"


@query(f"""
WITH b AS (SELECT p_partkey, p_type, kind, row_number() OVER (PARTITION BY p_partkey ORDER BY priority DESC, length(prefix) DESC) AS n FROM part JOIN {LPM_SQL} ON starts_with(lower(p_type), lower(prefix)))
SELECT p_partkey, p_type, kind FROM b WHERE n = 1""")
def classify_lpm(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {LPM_SQL}")
    return classify.longest_prefix(table(spark, d, "part"), "p_type", rules, ["p_partkey"])


@query("""
WITH h AS (SELECT doc_id, r.id, 2 * CAST(m <> '' AS INTEGER) + CAST(o <> '' AS INTEGER) AS score FROM documents JOIN (VALUES (1, 'en', 'thth', '', ''), (2, 'en', 'idiot|moron', 'src1', ''), (3, 'de', 'und', '', ''), (4, 'de', 'und', 'src[0-4]$', 'src2'), (5, 'en', '[.]', '', '7$')) AS r(id, vendor, c, m, o)
  ON lang = vendor AND regexp_matches(text, c) AND (m = '' OR regexp_matches(source, m)) AND (o = '' OR regexp_matches(source, o)))
SELECT d.doc_id, arg_max(h.id, h.score * 100 - h.id) AS rule, max(score) AS score FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def rule_match_4d(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"id": 1, "vendor": "en", "content": ["thth"]}, {"id": 2, "vendor": "en", "content": ["idiot", "moron"], "model": "src1"}, {"id": 3, "vendor": "de", "content": ["und"]}, {"id": 4, "vendor": "de", "content": ["und"], "model": "src[0-4]$", "os": "src2"}, {"id": 5, "vendor": "en", "content": ["[.]"], "os": "7$"}]
    return classify.best_rule(table(spark, d, "documents"), ["doc_id"], rules, "lang", "source", "source", "text")


HINT_SQL = "(VALUES ('Re', 'x'), ('red', 'y'), ('blue', 'z'), ('gree', 'a'), ('een', 'b'), ('part', 'p')) AS h(keyword, result)"


@query(f"""
WITH b AS (SELECT DISTINCT p_name, keyword, result FROM part JOIN {HINT_SQL} ON contains(lower(p_name), lower(keyword)))
SELECT p_name, keyword, result FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY length(keyword) DESC, keyword) AS n FROM b) WHERE n = 1""")
def hint_contains(spark: SparkSession, d: str) -> DataFrame:
    return classify.longest_hint(table(spark, d, "part"), "p_name", spark.sql(f"SELECT * FROM {HINT_SQL}")).select("p_name", "keyword", "result")


LONG_WORDS_SQL = "words AS (SELECT w, CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 10)"


def _long_words(spark: SparkSession, d: str) -> DataFrame:
    """w, id: the long words of the benchmark, in order."""
    found = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) >= 10").distinct()
    return numbered(found.withColumn("all", F.lit("")), "all", ["w"]).select("w", (F.col("index") + 1).cast("int").alias("id"))


@query(f"WITH {LONG_WORDS_SQL} SELECT DISTINCT doc_id, w AS mention FROM documents JOIN words ON contains(lower(text), w)")
def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions(table(spark, d, "documents"), ["doc_id"], F.col("text"), _long_words(spark, d), "w")


@query(f"""
WITH {LONG_WORDS_SQL}, rules AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END AS vendor, w || '[ .,]' AS content, CASE WHEN id % 3 = 0 THEN 'src[0-4]$' END AS model, CASE WHEN id % 5 = 0 THEN '[135]' ELSE '' END AS os FROM words UNION ALL SELECT 0, 'de', '^.*[.]', NULL, '7$'),
h AS (SELECT doc_id, id, 2 * CAST(model IS NOT NULL AS INTEGER) + CAST(os <> '' AS INTEGER) AS score FROM documents JOIN rules ON lang = vendor WHERE (id = 0 OR contains(text, left(content, length(content) - 5))) AND regexp_matches(text, content) AND (model IS NULL OR regexp_matches(source, model)) AND (os = '' OR regexp_matches(source, os)))
SELECT d.doc_id, arg_max(h.id, h.score * 1000000 - h.id) AS rule, max(score) AS score FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def rules_as_data(spark: SparkSession, d: str) -> DataFrame:
    word, none = F.col("id"), F.lit(None).cast("string")
    rules = _long_words(spark, d).select("id", F.when(word % 2 == 0, "en").otherwise("fr").alias("vendor"), F.concat("w", F.lit("[ .,]")).alias("content"), F.when(word % 3 == 0, "src[0-4]$").alias("model"), F.when(word % 5 == 0, "[135]").otherwise("").alias("os"))
    rules = rules.union(spark.range(1).select(F.lit(0), F.lit("de"), F.lit("^.*[.]"), none, F.lit("7$")))
    return best_rules(table(spark, d, "documents"), ["doc_id"], rules, "lang", "source", "source", "text")


@query(f"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]')) AS l FROM documents),
n AS (SELECT doc_id, len(l) AS total, len(list_filter(l, lambda x: regexp_matches(x, '{commands.HELP_LINE}'))) AS hits, len(list_filter(l, lambda x: regexp_matches(x, '{commands.DATA}'))) AS data, len(list_filter(l, lambda x: regexp_matches(x, '{commands.HELP_TEXT}'))) AS told FROM l)
SELECT doc_id, (data = 0 AND total >= 3 AND hits >= 0.8 * total AND (told >= 2 OR told >= 0.4 * total)) OR list_bool_or(list_transform([{', '.join("'" + m + "'" for m in commands.HELP_MARKS)}], lambda m: contains(text, m))) AS is_help FROM n JOIN documents USING (doc_id)""")
def help_echo_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", commands.is_help(F.col("text")).alias("is_help"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in commands.CATEGORIES) + " ELSE 'other' END AS category FROM documents")
def category_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", commands.category(F.col("text")).alias("category"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", commands.content_hash(F.col("text")).alias("content_hash"), commands.shortened(F.col("text"), 40).alias("short"))


# What is stored, and merges.


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""
SELECT o_custkey, o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY 1) m ON o_custkey = c AND o_orderkey = k""")
def latest_facts(spark: SparkSession, d: str) -> DataFrame:
    last = merge.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return table(spark, d, "lineitem").join(last, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha256(text) AS hash FROM documents GROUP BY text")
def dedup_min_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return merge.first_by(rows, ["hash"], F.col("doc_id"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def upsert_newer_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    stored, batch = rows.where("event_type = 'signup'"), rows.where("event_type <> 'signup'")
    return merge.newer_wins(stored, batch, ["user_id"], "ts", "event_id").drop("ts")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS kind, value FROM events)
SELECT user_id, max(event_id) AS event_id, coalesce(arg_max(kind, event_id) FILTER (WHERE kind <> ''), '') AS kind, arg_max(value, event_id) AS value FROM e GROUP BY user_id""")
def upsert_nonempty(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("kind"), "value")
    return merge.keep_filled(rows, ["user_id"], F.col("event_id"), ["kind"])


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def fifo_keep_n(spark: SparkSession, d: str) -> DataFrame:
    return merge.newest(table(spark, d, "events").select("event_id", "user_id", "event_type"), 200, "event_id")


@query("SELECT sha256(text) AS hash, count(*) AS occurrences, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY 1")
def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    return merge.counted(table(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id"), ["hash"], "doc_id")


@query("""
SELECT min(doc_id) AS doc_id, source, sha256(text) AS hash FROM documents d WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source AND e.text = d.text) GROUP BY source, text""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("hash"))
    return merge.insert_absent(rows.where("lang = 'en'").drop("lang"), rows.where("lang <> 'en'").drop("lang"), ["source", "hash"], F.col("doc_id"))


@query("SELECT source, sha256(text) AS content_hash, min(doc_id) AS doc_id, min(doc_id) > (SELECT min(doc_id) FROM documents e WHERE e.source = d.source) AS changed FROM documents d GROUP BY source, text")
def config_history(spark: SparkSession, d: str) -> DataFrame:
    return merge.changed_texts(table(spark, d, "documents").select("source", "text", "doc_id"), "source", "text", "doc_id").select("source", "content_hash", "doc_id", "changed")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_expected(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.cascade(table(spark, d, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_reset(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return merge.affected(table(spark, d, "part"), lines, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return merge.duplicates(table(spark, d, "events"), ["user_id", "event_type"])


@query("""
SELECT o_custkey, o_orderkey, CAST(age AS INTEGER) AS age FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders) WHERE age <= 2""")
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    return merge.versions(table(spark, d, "orders"), "o_custkey", "o_orderkey", 2)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus IN ('O', 'P') THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_machine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.transition(rows, "o_orderstatus", {"O": ("P", "F"), "P": ("F",)}, "F", F.col("o_totalprice") > 200000).drop("o_totalprice")


# Summaries.


@query("""
WITH r AS (SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT c_nationkey AS nation, count(*) AS members, count(DISTINCT c_mktsegment) AS different, string_agg(c_name, ',' ORDER BY n) FILTER (WHERE n <= 3) AS samples FROM r GROUP BY 1""")
def group_summary_samples(spark: SparkSession, d: str) -> DataFrame:
    return reports.group_summary(table(spark, d, "customer"), F.col("c_nationkey"), "nation", "c_mktsegment", "c_name", F.col("c_custkey"))


@query("""
SELECT source, lang, count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id) * 1.0::DOUBLE / count(*) * 100, 6) AS pct FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source, lang""")
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).withColumn("pct", six(F.col("pct")))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("known"))
    return reports.coverage(table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left"), ["source", "lang"], F.col("known").isNotNull())


@query("""
WITH c AS (SELECT count(l.doc_id) * 1.0::DOUBLE / count(*) * 100 AS pct FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source, lang)
SELECT count(*) AS groups, round(avg(pct), 6) AS avg_pct, count(*) FILTER (WHERE pct >= 100) AS "full", count(*) FILTER (WHERE pct > 0 AND pct < 100) AS part, count(*) FILTER (WHERE pct = 0) AS none FROM c""")
def coverage_overview(spark: SparkSession, d: str) -> DataFrame:
    return reports.buckets(_covered(spark, d)).withColumn("avg_pct", six(F.col("avg_pct")))


@query("""
WITH r AS (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment AS segment, count(*) AS members, count(DISTINCT o_orderkey) AS different, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 5) AS samples FROM r GROUP BY 1""")
def cluster_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("order", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return reports.group_summary(rows, F.col("c_mktsegment"), "segment", "o_orderkey", "o_orderkey", F.col("order"), 5)


@query("""
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, bool_and(o_totalprice > 0) AS all_priced, bool_or(o_orderstatus = 'P') AS some_open FROM orders GROUP BY 1""")
def precheck_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"), F.bool_or(F.col("o_orderstatus") == "P").alias("some_open"))


#: Facts of devices from lineitems: an order is a device, its lineitems are neighbours, interfaces and expected peers.
FACTS_SQL = """
seen AS (SELECT l_orderkey AS device_id, l_linenumber % 2 = 0 AS igp, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag <> 'R' ELSE l_linestatus = 'F' END AS up, l_partkey AS peer FROM lineitem),
due AS (SELECT DISTINCT l_orderkey AS device_id, l_partkey AS peer FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 25)"""


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """devices, neighbours, interfaces, expected peers, as FACTS_SQL has them."""
    lines, igp = table(spark, d, "lineitem"), F.col("l_linenumber") % 2 == 0
    states = F.when(igp, F.when(F.col("l_returnflag") != "R", "Full/DR").otherwise("Init")).otherwise(F.when(F.col("l_linestatus") == "F", "Established").otherwise("Idle"))
    peer = F.col("l_partkey").cast("string")
    neighbors = lines.select(F.col("l_orderkey").alias("device_id"), F.when(igp, "ospf").otherwise("bgp").alias("protocol"), states.alias("state"), peer.alias("remote_id"))
    interfaces = lines.select(F.col("l_orderkey").alias("device_id"), F.when(F.col("l_quantity") > 10, "up").otherwise("down").alias("status"))
    peers = lines.where("l_linenumber <= 2 and l_quantity > 25").select(F.col("l_orderkey").alias("device_id"), peer.alias("peer_ip"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("hostname")), neighbors, interfaces, peers


@query(f"""
WITH {FACTS_SQL}, n AS (
  SELECT device_id, count(*) FILTER (WHERE igp) AS ospf, count(*) FILTER (WHERE igp AND up) AS ospf_full, count(*) FILTER (WHERE NOT igp) AS bgp, count(*) FILTER (WHERE NOT igp AND up) AS bgp_up FROM seen GROUP BY 1),
f AS (SELECT l_orderkey AS device_id, count(*) AS interfaces, count(*) FILTER (WHERE l_quantity > 10) AS interfaces_up FROM lineitem GROUP BY 1),
m AS (SELECT device_id, count(*) AS missing FROM due WHERE NOT EXISTS (SELECT 1 FROM seen WHERE NOT igp AND seen.device_id = due.device_id AND seen.peer = due.peer) GROUP BY 1),
o AS (SELECT o_orderkey AS device_id, coalesce(ospf, 0) AS ospf, coalesce(ospf_full, 0) AS ospf_full, coalesce(bgp, 0) AS bgp, coalesce(bgp_up, 0) AS bgp_up, coalesce(interfaces, 0) AS interfaces, coalesce(interfaces_up, 0) AS interfaces_up, coalesce(missing, 0) AS missing
  FROM orders LEFT JOIN n ON n.device_id = o_orderkey LEFT JOIN f ON f.device_id = o_orderkey LEFT JOIN m ON m.device_id = o_orderkey)
SELECT *, ospf = ospf_full AND bgp = bgp_up AND missing = 0 AS safe FROM o""")
def device_precheck(spark: SparkSession, d: str) -> DataFrame:
    return topology.precheck(*_facts(spark, d))


@query(f"""
WITH {FACTS_SQL}
SELECT o_orderkey AS device_id, o_orderpriority AS hostname, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS interfaces, (SELECT count(*) FROM due WHERE device_id = o_orderkey) AS peers, (SELECT count(DISTINCT peer) FROM seen WHERE device_id = o_orderkey) AS linked
FROM orders""")
def device_summary(spark: SparkSession, d: str) -> DataFrame:
    devices, neighbors, interfaces, peers = _facts(spark, d)
    return topology.summary(devices, interfaces, peers, neighbors.select("device_id", F.col("remote_id").alias("peer")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate, avg(CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1.0 ELSE 0.0 END) >= 0.5 AS ok FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def nonempty_rate(spark: SparkSession, d: str) -> DataFrame:
    return reports.filled_rates(table(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"]).withColumn("rate", six(F.col("rate")))


@query(r"""
WITH l AS (SELECT doc_id, regexp_replace(regexp_extract(unnest(string_split(text, chr(10))), '^[\s\x0b]*([^\s\x0b]+[\s\x0b]+[^\s\x0b]+)', 1), '[\s\x0b]+', ' ', 'g') AS prefix FROM documents)
SELECT doc_id, prefix, count(*) AS lines FROM l WHERE prefix <> '' GROUP BY 1, 2 HAVING count(*) >= 3""")
def prefix_repeat_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return reports.repeated_prefixes(table(spark, d, "documents"), "doc_id", "text")


# Differences.


@query("""
WITH p AS (SELECT conv_id, turn, text AS new, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
o AS (SELECT conv_id, turn, new, unnest(string_split(old, chr(10))) AS line, generate_subscripts(string_split(old, chr(10)), 1) - 1 AS pos FROM p WHERE old IS NOT NULL),
n AS (SELECT conv_id, turn, old, unnest(string_split(new, chr(10))) AS line, generate_subscripts(string_split(new, chr(10)), 1) - 1 AS pos FROM p WHERE old IS NOT NULL)
SELECT conv_id, turn, '-' AS side, CAST(pos AS INTEGER) AS pos, line FROM o WHERE NOT list_contains(string_split(new, chr(10)), line)
UNION ALL SELECT conv_id, turn, '+', CAST(pos AS INTEGER), line FROM n WHERE NOT list_contains(string_split(old, chr(10)), line)""")
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, d, "conversations").withColumn("old", before).where("old is not null")
    return reports.line_difference(pairs, ["conv_id", "turn"], "old", "text")


@query("""
WITH RECURSIVE p AS (SELECT conv_id, turn, string_split(text, ' ') AS new, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS old FROM conversations),
q AS MATERIALIZED (SELECT * FROM p WHERE old IS NOT NULL),
r AS (SELECT conv_id, turn, 0 AS i, list_transform(range(len(new) + 1), lambda z: 0::BIGINT) AS same FROM q
  UNION ALL SELECT r.conv_id, r.turn, i + 1, list_reduce([[0::BIGINT]] || list_transform(range(1, len(new) + 1), lambda j: [CASE WHEN old[i + 1] = new[j] THEN same[j] + 1 ELSE same[j + 1] END]), lambda acc, v: acc || [greatest(acc[-1], v[1])])
  FROM r JOIN q ON q.conv_id = r.conv_id AND q.turn = r.turn WHERE i < len(old))
SELECT q.conv_id, q.turn, same[-1] AS kept, len(old) - same[-1] AS gone, len(new) - same[-1] AS new FROM q JOIN r ON q.conv_id = r.conv_id AND q.turn = r.turn AND i = len(old)""")
def edit_scripts(spark: SparkSession, d: str) -> DataFrame:
    """How many words a shortest edit script keeps, takes and adds from each turn to the next."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    lines = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("\n"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\v")).alias("text")).withColumn("old", before).where("old is not null")
    script = reports.sequence_difference(pairs.select("conv_id", "turn", lines("old").alias("old"), lines("text").alias("text")), ["conv_id", "turn"], "old", "text")
    return script.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("sign") == s).alias(n) for s, n in ((" ", "kept"), ("-", "gone"), ("+", "new"))))


@query("""
WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS VARCHAR) AS n, CAST(max(c_custkey) AS VARCHAR) AS m FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS VARCHAR) AS n, CAST(max(s_suppkey) AS VARCHAR) AS m FROM supplier GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.n AS an, b.n AS bn, a.m AS am, b.m AS bm FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'n' AS field, an AS expected, bn AS actual FROM j WHERE an IS DISTINCT FROM bn UNION ALL SELECT k, 'm', am, bm FROM j WHERE am IS DISTINCT FROM bm""")
def row_diff_report(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("m"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("s_suppkey").alias("m"))
    return reports.row_difference(a, b, ["k"], ["n", "m"])


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), a AS (SELECT l_orderkey AS k, l_partkey, l_suppkey FROM v WHERE l_linenumber = 1), b AS (SELECT l_orderkey AS k, l_partkey, l_suppkey FROM v WHERE l_linenumber = 2),
j AS (SELECT coalesce(a.k, b.k) AS k, a.l_partkey AS ap, b.l_partkey AS bp, a.l_suppkey AS s, b.l_suppkey AS t FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'l_partkey' AS field, CAST(ap AS VARCHAR) AS expected, CAST(bp AS VARCHAR) AS actual FROM j WHERE ap IS DISTINCT FROM bp UNION ALL SELECT k, 'l_suppkey', CAST(s AS VARCHAR), CAST(t AS VARCHAR) FROM j WHERE s IS DISTINCT FROM t""")
def route_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey"))
    return reports.row_difference(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), ["k"], ["l_partkey", "l_suppkey"])


# Addresses and graphs.

IP_SQL = "'10.' || CAST(c_custkey // 65536 % 256 AS VARCHAR) || '.' || CAST(c_custkey // 256 % 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR)"


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.pmod(F.floor(F.col("c_custkey") / n), F.lit(256)).cast("string")
    mask = F.when(F.col("c_custkey") % 2 == 0, "30").otherwise("255.255.255.252")
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(".", F.lit("10"), part(65536), part(256), part(1)).alias("ip"), mask.alias("mask"))


@query(f"SELECT c_custkey, {IP_SQL} AS ip, '10.' || CAST(c_custkey // 65536 % 256 AS VARCHAR) || '.' || CAST(c_custkey // 256 % 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 // 4 * 4 AS VARCHAR) || '/30' AS subnet FROM customer")
def subnet_id(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("c_custkey", "ip", network.subnet(F.col("ip"), F.col("mask")).alias("subnet"))


@query(f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey // 4 = b.c_custkey // 4 AND a.c_custkey < b.c_custkey")
def subnet_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.links_by_subnet(_addresses(spark, d), "c_custkey", "ip", "mask").select("a", "b")


# A root, regions, nations and suppliers, each tied both ways to what holds it.
EDGES_SQL = """ties AS (SELECT 0::BIGINT AS a, 1 + r_regionkey::BIGINT AS b FROM region UNION ALL SELECT 1 + n_regionkey::BIGINT, 100 + n_nationkey::BIGINT FROM nation UNION ALL SELECT 100 + s_nationkey::BIGINT, 1000 + s_suppkey::BIGINT FROM supplier),
edges AS (SELECT a AS src, b AS dst FROM ties UNION ALL SELECT b, a FROM ties)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    tie = lambda df, a, base, b, other: df.select((F.lit(base) + F.col(a).cast("long")).alias("a"), (F.lit(other) + F.col(b).cast("long")).alias("b"))
    region = table(spark, d, "region").withColumn("root", F.lit(0))
    ties = tie(region, "root", 0, "r_regionkey", 1).union(tie(table(spark, d, "nation"), "n_regionkey", 1, "n_nationkey", 100)).union(tie(table(spark, d, "supplier"), "s_nationkey", 100, "s_suppkey", 1000))
    return ties.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {EDGES_SQL} SELECT src AS node, count(*) AS out_degree FROM edges GROUP BY src")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst")
def peer_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(_edges(spark, d), "src", "dst")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN edges ON node = src WHERE hops < 8)
SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def graph_bfs_dist(spark: SparkSession, d: str) -> DataFrame:
    start = spark.range(1).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return graph.distances(_edges(spark, d), start).select("node", "hops")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, r AS (SELECT [0::BIGINT] AS p UNION ALL SELECT list_append(p, dst) FROM r JOIN edges ON p[-1] = src WHERE NOT list_contains(p, dst) AND len(p) < 4)
SELECT array_to_string(p, '-') AS path FROM r""")
def graph_all_paths(spark: SparkSession, d: str) -> DataFrame:
    start = spark.range(1).select(F.col("id").alias("node"))
    return graph.simple_paths(_edges(spark, d), start, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


# The suppliers of each nation in a row by key, the first behind the nation; of nations with even keys the last leads back to it.
ROW_SQL = """line AS (SELECT 1000 + s_suppkey::BIGINT AS id, 100 + s_nationkey::BIGINT AS nation, lag(1000 + s_suppkey::BIGINT) OVER w AS before, lead(s_suppkey) OVER w IS NULL AS last FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
ways AS (SELECT 0::BIGINT AS src, 1 + r_regionkey::BIGINT AS dst FROM region UNION ALL SELECT 1 + n_regionkey::BIGINT, 100 + n_nationkey::BIGINT FROM nation UNION ALL SELECT coalesce(before, nation), id FROM line UNION ALL SELECT id, nation FROM line WHERE last AND nation % 2 = 0),
edges AS (SELECT src, dst FROM ways UNION ALL SELECT dst, src FROM ways), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""


def _ways(spark: SparkSession, d: str) -> DataFrame:
    long = lambda c, base: (F.lit(base) + F.col(c).cast("long"))
    region = table(spark, d, "region").select(F.lit(0).cast("long").alias("src"), long("r_regionkey", 1).alias("dst"))
    nation = table(spark, d, "nation").select(long("n_regionkey", 1), long("n_nationkey", 100))
    line = numbered(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("of"), long("s_nationkey", 100).alias("nation"), long("s_suppkey", 1000).alias("id")), "of", ["id"])
    before = line.select("of", F.col("id").alias("before"), (F.col("index") + 1).alias("index"))
    row = line.join(before, ["of", "index"], "left").select(F.coalesce("before", "nation"), "id")
    back = line.where((F.col("index") + 1 == F.col("count")) & (F.col("nation") % 2 == 0)).select("id", "nation")
    return region.union(nation).union(row).union(back)


def _both_ways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of _ways(), which count both ways."""
    ways = cut(_ways(spark, d))
    edges = ways.union(ways.select("dst", "src"))
    return edges.select(F.col("src").alias("id")).distinct(), edges


@query(f"""
WITH RECURSIVE {ROW_SQL}, r AS (SELECT src AS o, dst AS node FROM ways UNION SELECT o, dst FROM r JOIN ways ON node = src)
SELECT DISTINCT node FROM r WHERE o = node""")
def graph_cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.on_cycles(_ways(spark, d))


LOST_SQL = """s AS (SELECT g.id AS gone, min(n.id) AS node FROM nodes g JOIN nodes n ON g.id <> n.id GROUP BY g.id),
r AS (SELECT gone, node FROM s UNION SELECT gone, dst FROM r JOIN edges ON node = src WHERE dst <> gone)"""


@query(f"""
WITH RECURSIVE {ROW_SQL}, {LOST_SQL}
SELECT g.id AS gone, n.id AS node FROM nodes g JOIN nodes n ON g.id <> n.id WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.gone = g.id AND r.node = n.id)""")
def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _both_ways(spark, d)
    return blocks.impact(nodes, edges, nodes)


@query(f"""
WITH RECURSIVE {ROW_SQL}, {LOST_SQL}, w AS (SELECT min(id) AS node FROM nodes UNION SELECT dst FROM w JOIN edges ON node = src)
SELECT g.id, count(*) AS cut_off FROM nodes g JOIN nodes n ON g.id <> n.id JOIN w ON w.node = n.id WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.gone = g.id AND r.node = n.id) GROUP BY g.id""")
def graph_spof(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _both_ways(spark, d)
    return blocks.cut_points(nodes, edges)


@query(f"""
WITH RECURSIVE {ROW_SQL}, {LOST_SQL}, l AS (SELECT g.id AS device, n.id AS node FROM nodes g JOIN nodes n ON g.id <> n.id WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.gone = g.id AND r.node = n.id))
SELECT id AS device, count(node) > 0 AS single_point, count(node) AS affected FROM nodes LEFT JOIN l ON id = device WHERE id BETWEEN 100 AND 999 GROUP BY id""")
def topology_single_points(spark: SparkSession, d: str) -> DataFrame:
    """What a topology says of each device asked about (here the nations): whether it is a single point, and what it would cut off."""
    nodes, edges = _both_ways(spark, d)
    return topology.single_points(nodes, edges, nodes.where("id between 100 and 999"))


@query(f"""
WITH RECURSIVE {ROW_SQL}, p AS (SELECT 1000 + s_suppkey::BIGINT AS a, 1000 + (SELECT max(s_suppkey) FROM supplier)::BIGINT AS b FROM supplier WHERE s_suppkey % 10 = 0),
r AS (SELECT DISTINCT a, a AS node, 0 AS hops FROM p UNION SELECT a, dst, hops + 1 FROM r JOIN edges ON node = src WHERE hops < 40)
SELECT p.a, p.b, min(hops) AS hops FROM p LEFT JOIN r ON r.a = p.a AND r.node = p.b GROUP BY p.a, p.b""")
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    _, edges = _both_ways(spark, d)
    keys = table(spark, d, "supplier").select((F.col("s_suppkey").cast("long") + 1000).alias("a"))
    pairs = keys.where("a % 10 = 0").join(F.broadcast(keys.agg(F.max("a").alias("b"))))  # a row
    return graph.shortest_paths(edges, pairs, 40).select("a", "b", (F.array_size("path") - 1).alias("hops"))


# Search and vectors.


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) * 1.0::DOUBLE AS l, len(list_filter(w, lambda x: x = 'the')) * 1.0::DOUBLE AS a, len(list_filter(w, lambda x: x = 'of')) * 1.0::DOUBLE AS b FROM t),
s AS (SELECT count(*) * 1.0::DOUBLE AS n, avg(l) AS v, count(*) FILTER (WHERE a > 0) * 1.0::DOUBLE AS da, count(*) FILTER (WHERE b > 0) * 1.0::DOUBLE AS db FROM c)
SELECT doc_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / v)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / v)), 6) AS score FROM c, s WHERE a > 0 AND b > 0""")
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "of"]).withColumn("score", six(F.col("score")))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) * 1.0::DOUBLE AS l, len(list_filter(w, lambda x: x = 'license')) * 1.0::DOUBLE AS a, len(list_filter(w, lambda x: x = 'under')) * 1.0::DOUBLE AS b FROM t),
s AS (SELECT count(*) * 1.0::DOUBLE AS n, avg(l) AS v, count(*) FILTER (WHERE a > 0) * 1.0::DOUBLE AS da, count(*) FILTER (WHERE b > 0) * 1.0::DOUBLE AS db FROM c)
SELECT doc_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / v)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / v)), 6) AS score FROM c, s WHERE a > 0 AND b > 0""")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    held = search.index(table(spark, d, "documents"), "doc_id", "text")
    return search.search_index(held, "doc_id", ["License", "under"]).withColumn("score", six(F.col("score")))


def _changed_index(spark: SparkSession, d: str) -> Index:
    """An index of documents in parts: every tenth is replaced by its first half, one in seven is deleted."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = Index(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", 16)
    held.add(docs.where("lang = 'en'"), "doc_id", "text")
    held.add(docs.where("lang <> 'en'"), "doc_id", "text")
    held.add(docs.where("doc_id % 10 = 0").select("doc_id", F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("text")), "doc_id", "text")
    held.delete(docs.where("doc_id % 7 = 3"), "doc_id")
    return held


CHANGED_SQL = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(text, length(text) // 2) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query(f"""
WITH {CHANGED_SQL}, p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS w FROM changed)
SELECT doc_id FROM p WHERE contains(w, ' of the ') AND contains(w, ' licen') AND NOT contains(w, ' mit ') OR contains(w, ' la de ') AND contains(w, ' eau')""")
def fts_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _changed_index(spark, d).match('"of the" licen* NOT mit OR "la de" eau*').withColumnRenamed("doc", "doc_id")


@query(f"""
WITH {CHANGED_SQL}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM changed),
c AS (SELECT doc_id, len(w) * 1.0::DOUBLE AS l, len(list_filter(w, lambda x: x = 'license')) * 1.0::DOUBLE AS a, len(list_filter(w, lambda x: x = 'under')) * 1.0::DOUBLE AS b FROM t),
s AS (SELECT count(*) * 1.0::DOUBLE AS n, avg(l) AS v, count(*) FILTER (WHERE a > 0) * 1.0::DOUBLE AS da, count(*) FILTER (WHERE b > 0) * 1.0::DOUBLE AS db FROM c)
SELECT doc_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / v)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / v)), 6) AS score FROM c, s WHERE a > 0 AND b > 0""")
def fts_changed(spark: SparkSession, d: str) -> DataFrame:
    held = _changed_index(spark, d)
    held.merge()
    return held.ranked(["license", "under"]).select(F.col("doc").alias("doc_id"), six(F.col("score")).alias("score"))


@query("""
SELECT version, what, o_orderstatus, count(*) AS n FROM (
  SELECT 1 AS version, 'order' AS what, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, 'line', o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT 2, 'order', o_orderstatus FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT 2, 'line', o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O') GROUP BY ALL""")
def atomic_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines come in together; a batch with one order twice leaves nothing, and each version can be read."""
    store = Store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", 16)
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")))
    lines = lines.select("l_orderkey", "line", "o_orderstatus")

    def batch(status: str, more: DataFrame | None = None) -> dict:
        own = orders.where(F.col("o_orderstatus") == status)
        return {"lines": (lines.where(F.col("o_orderstatus") == status), ["l_orderkey", "line"]), "orders": (own if more is None else own.union(more), ["o_orderkey"])}

    store.insert(batch("F"))
    first = orders.where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(1)
    if not first.isEmpty():
        try:
            store.insert(batch("O", first))
            raise AssertionError("the batch repeats an order")
        except Duplicate:
            pass
    store.insert(batch("P"))
    found = None
    for n in (1, 2):
        for name, what in (("orders", "order"), ("lines", "line")):
            own = store.at(n).read(name).groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(n).alias("version"), F.lit(what).alias("what"), "o_orderstatus", "n")
            found = own if found is None else found.union(own)
    return found


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", search.snippet(F.col("text")).alias("snippet"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q),
t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 6) AS score FROM t WHERE score > 0.3""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()
    return search.top_k(rows, "vec_id", "embedding", list(asked.embedding), 10).withColumn("score", six(F.col("score")))


@query("""
WITH u AS (SELECT 'part' AS source, p_name AS title, p_retailprice AS score, p_partkey AS k FROM part UNION ALL SELECT 'order', o_orderpriority, o_totalprice / 100, o_orderkey FROM orders)
SELECT source, title, round(score, 6) AS score, k FROM u ORDER BY u.score DESC, source, k LIMIT 20""")
def knowledge_merge(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("k"))
    orders = table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderpriority").alias("title"), (F.col("o_totalprice") / 100).alias("score"), F.col("o_orderkey").alias("k"))
    return search.merged([parts, orders], 20, ["source", "k"]).withColumn("score", six(F.col("score")))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: length(x) > 50) AS c FROM documents)
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk FROM p""")
def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(search.chunks(F.col("text"), "\n")).alias("chunk_no", "chunk"))


@query("""
WITH m AS (SELECT conv_id, turn, role, length(text) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r,
  sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s, first_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)
SELECT conv_id, turn, role FROM m WHERE i = 1 OR s + h <= 1500 OR r < 3""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return reports.within_budget(table(spark, d, "conversations"), "conv_id", "turn", "text", 1500).select("conv_id", "turn", "role")


RULE_SQL = "(VALUES ('admin', '*'), ('buyer', 'pur*'), ('buyer', 'view'), ('guest', 'view')) AS g(grp, rule)"


@query(f"SELECT DISTINCT event_type, grp, CASE WHEN bool_or(rule = '*' OR event_type LIKE replace(rule, '*', '%')) THEN true ELSE false END AS allowed FROM (SELECT DISTINCT event_type FROM events), {RULE_SQL} GROUP BY 1, 2")
def permission_match(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.sql(f"SELECT grp, collect_list(rule) AS rules FROM {RULE_SQL} GROUP BY grp").select(F.collect_list(F.struct("grp", "rules")).alias("all")).first()["all"]
    kinds = table(spark, d, "events").select("event_type").distinct()
    each = F.array(*(F.struct(F.lit(g["grp"]).alias("grp"), F.exists(F.array(*map(F.lit, g["rules"])), lambda r: classify.tool_allowed(F.col("event_type"), r)).alias("allowed")) for g in groups))
    return kinds.select("event_type", F.explode(each).alias("g")).select("event_type", "g.*")


# Scans and events.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), order=["-o_totalprice", "o_orderkey"], limit=50, offset=100)


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 10 AND lower(p_type) LIKE '%eco%'")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "part"), {"p_size": 10, "p_brand": None}, {"p_type": "Eco", "p_name": ""}).select("p_partkey", "p_name")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), six(F.sum("value")).alias("value"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), six(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))
