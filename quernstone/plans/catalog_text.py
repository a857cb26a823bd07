"""Registered queries of the text, sampling, matching, corpus and streaming operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import types as ty
from ..operators import corpus, matching, sampling
from ..operators import text as ot
from ..session import scratch_dir, table
from ..sources import bodies, files
from ..streaming import events as se
from .catalog import query

# text functions and retrieval

QUERY_TEXT = "the thing of and tion re the in erly anor ther onhe"


@query(f"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tok FROM documents), q AS (SELECT unnest(regexp_extract_all('{QUERY_TEXT}', '[a-z0-9_]+')) AS tok),
    h AS (SELECT doc_id, CAST('0x' || left(sha256(tok), 8) AS BIGINT) % 384 AS dim, sum(CASE WHEN CAST('0x' || substring(sha256(tok), 9, 2) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w FROM t GROUP BY ALL),
    hn AS (SELECT doc_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM h WHERE w <> 0),
    g AS (SELECT CAST('0x' || left(sha256(tok), 8) AS BIGINT) % 384 AS dim, sum(CASE WHEN CAST('0x' || substring(sha256(tok), 9, 2) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w FROM q GROUP BY ALL),
    gn AS (SELECT dim, w / sqrt(sum(w * w) OVER ()) AS w FROM g WHERE w <> 0)
    SELECT doc_id, round(sum(hn.w * gn.w), 9) AS score FROM hn JOIN gn ON hn.dim = gn.dim GROUP BY doc_id HAVING round(sum(hn.w * gn.w), 9) > 0 ORDER BY score DESC, doc_id LIMIT 20
""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = ot.hashed_vectors(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")
    asked = ot.hashed_vectors(spark.createDataFrame([(QUERY_TEXT,)], "text string").withColumn("k", F.lit(0)), ["k"], "text")
    return ot.vector_top_k(vectors, ["doc_id"], asked, 20)


@query()
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every text with their places; cuts depend on the text before them, which SQL can't follow."""
    return ot.chunks(table(spark, sf, "documents"), "doc_id").select("doc_id", "char_start", "char_end", F.length("excerpt").alias("chars"))


_CUES_SQL = ", ".join(f"count(*) FILTER (length(trim(text)) >= 4 AND regexp_matches(trim(text), '(?i){p}')) AS cue_{n}" for n, p in ft.CUES.items())


@query(f"""SELECT conv_id, count(*) AS turns, count(*) FILTER (length(trim(text)) >= 4) AS content_turns, count(DISTINCT text) AS distinct_texts, count(text) - count(DISTINCT text) AS repeated_texts,
    count(DISTINCT role) AS roles, median(length(text)) AS median_chars, {_CUES_SQL} FROM conversations GROUP BY 1""")
def chat_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ot.conversation_profile(table(spark, sf, "conversations"))


@query("""WITH m AS (SELECT conv_id // 3 AS conversation, concat('chat/', conv_id, '.json') AS path, md5(concat(role, '|', text)) AS k, strlen(text) AS b FROM conversations),
    e AS (SELECT conversation, path, count(DISTINCT k) AS unique_messages, count(*) AS messages, CAST(coalesce(sum(b), 0) AS BIGINT) AS size_bytes FROM m GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, first_value(path) OVER w AS canonical_path, CASE WHEN row_number() OVER w = 1 THEN 'canonical' ELSE 'variant' END AS status FROM e
    WINDOW w AS (PARTITION BY conversation ORDER BY unique_messages DESC, messages DESC, size_bytes DESC, path DESC)""")
def canonical_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbouring conversations as exports of one."""
    c = table(spark, sf, "conversations")
    m = c.select(F.floor(F.col("conv_id") / 3).alias("conversation"), F.concat(F.lit("chat/"), F.col("conv_id"), F.lit(".json")).alias("path"), F.md5(F.concat_ws("|", "role", "text")).alias("k"), F.octet_length("text").alias("b"))
    return ot.rank_exports(m, "conversation", "path", "k", F.col("b"))


@query()
def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Body, title and authors of every page's article; an HTML parser is beyond SQL."""
    return bodies.page_bodies(table(spark, sf, "pages"), "page_id", "html", tag="article").drop("images")


@query("""WITH p AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (length(trim(text)) >= 4) AS content_turns, count(text) - count(DISTINCT text) AS repeated_texts FROM conversations GROUP BY 1)
    SELECT CASE WHEN turns >= 5 THEN 'long' ELSE 'short' END AS length_class, count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(content_turns) AS BIGINT) AS content_turns,
    CAST(sum(repeated_texts) AS BIGINT) AS repeated_texts, round(sum(content_turns) / sum(turns), 4) AS content_turns_rate, round(sum(repeated_texts) / sum(turns), 4) AS repeated_texts_rate FROM p GROUP BY 1""")
def chat_type_rates(spark: SparkSession, sf: str) -> DataFrame:
    p = ot.conversation_profile(table(spark, sf, "conversations"))
    return ot.type_rates(p, F.when(F.col("turns") >= 5, "long").otherwise("short"), "length_class", ["content_turns", "repeated_texts"], "turns")


@query("""WITH c AS (SELECT conv_id, role, count(*) AS messages FROM conversations GROUP BY ALL)
    SELECT * FROM (SELECT conv_id, role, messages, round(messages / sum(messages) OVER (PARTITION BY conv_id), 4) AS share, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY messages DESC, role) AS INTEGER) AS rank FROM c) WHERE rank <= 8""")
def chat_roles(spark: SparkSession, sf: str) -> DataFrame:
    return ot.top_senders(table(spark, sf, "conversations"), "conv_id", "role")


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 4 THEN left(text, 80) END AS body FROM conversations)
    SELECT * FROM (SELECT conv_id, turn, body, last_value(body IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(body IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM b) WHERE body IS NOT NULL""")
def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    return ot.neighbour_context(table(spark, sf, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, turn, CASE least(2, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 3) // count(*) OVER (PARTITION BY conv_id)) WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS stratum FROM conversations""")
def chat_strata(spark: SparkSession, sf: str) -> DataFrame:
    return ot.time_strata(table(spark, sf, "conversations"), "conv_id", "turn")


_TAGS_SQL = " + ".join(f"regexp_matches(trim(text), '(?i){p}')::INT" for p in ft.CUES.values())


@query(f"""WITH s AS (SELECT conv_id, turn, text, CASE least(2, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 3) // count(*) OVER (PARTITION BY conv_id)) WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS stratum FROM conversations),
    c AS (SELECT conv_id, turn, stratum, CAST({_TAGS_SQL} AS INTEGER) AS cues, sha256('review|' || conv_id || '|' || turn) AS draw FROM s WHERE length(trim(text)) >= 4)
    SELECT conv_id, turn, stratum, cues, pick FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, stratum ORDER BY cues DESC, draw) AS INTEGER) AS pick FROM c) WHERE pick <= 1""")
def chat_review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ot.review_sample(table(spark, sf, "conversations"), "conv_id", "turn", 1, "review")


#: DuckDB's patterns look neither ahead nor behind: there the numbers are taken between separators, each of which is doubled first.
_NUMBERS_SQL = {"mainland_phone": "(?:^|[^0-9])(1[3-9][0-9]{9})(?:$|[^0-9])", "mainland_id": "(?:^|[^0-9])([0-9]{17}[0-9Xx])(?:$|[^0-9])"}


def _matches_sql(name: str, pattern: str) -> str:
    if name in _NUMBERS_SQL:
        return f"regexp_extract_all(regexp_replace(body, '([^0-9Xx])', '\\1\\1', 'g'), '{_NUMBERS_SQL[name]}', 1)"
    return f"regexp_extract_all(body, '({pattern})')"


_LINES_SQL = f"string_split_regex(text, '{ft.LINE_ENDS}')"
_SENSITIVE_SQL = " UNION ALL ".join(f"SELECT doc_id, line, '{n}' AS kind, '{s}' AS severity, unnest({_matches_sql(n, p)}) AS m FROM l" for n, (s, p) in ft.SENSITIVE.items())
_NOTES_SQL = """SELECT c_custkey AS doc_id, c_name || ': 13' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || chr(13) || chr(10) || CASE WHEN c_acctbal < 0 THEN 'password: ' || c_name ELSE 'open' END || chr(10)
    || CASE WHEN c_nationkey % 5 = 0 THEN 'key sk-' || left(sha256(c_name), 20) ELSE 'id 1101011990' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS text FROM customer"""
_FOUND_SQL = f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {_NOTES_SQL}), l AS (SELECT doc_id, unnest({_LINES_SQL}) AS body, generate_subscripts({_LINES_SQL}, 1) AS line FROM d), f AS ({_SENSITIVE_SQL})"


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, which hold nothing that the patterns look for, and notes on customers with numbers, passwords and keys of theirs."""
    key = F.col("c_custkey").cast("string")
    secret = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("password: "), "c_name")).otherwise("open")
    token = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("key sk-"), F.left(F.sha2("c_name", 256), F.lit(20)))).otherwise(F.concat(F.lit("id 1101011990"), F.lpad(key, 8, "0")))
    notes = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(": 13"), F.lpad(key, 9, "0"), F.lit("\r\n"), secret, F.lit("\n"), token).alias("text"))
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(notes)


@query(f"{_FOUND_SQL} SELECT doc_id, line, kind, severity, left(sha256(m), 16) AS fingerprint FROM f")
def sensitive_findings(spark: SparkSession, sf: str) -> DataFrame:
    return ot.sensitive_findings(_notes(spark, sf), "doc_id")


@query(f"{_FOUND_SQL} SELECT severity, count(*) AS findings, count(DISTINCT left(sha256(m), 16)) AS fingerprints FROM f GROUP BY 1")
def sensitive_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ot.severity_summary(ot.sensitive_findings(_notes(spark, sf), "doc_id"))


@query("""WITH r AS (SELECT lang, source, length(text) AS c, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC) AS k FROM documents)
    SELECT lang, source, count(*) AS texts, median(c) AS median_chars, CAST(sum(c) AS BIGINT) AS chars, round(sum(c) FILTER (k <= 4) / sum(c), 4) AS top_share FROM r GROUP BY ALL""")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ot.corpus_profile(table(spark, sf, "documents"), ["lang", "source"])


@query("""SELECT body, count(DISTINCT source) AS units, count(*) AS occurrences FROM (SELECT source, unnest(string_split(text, chr(10))) AS body FROM documents) WHERE length(body) BETWEEN 8 AND 240
    GROUP BY 1 HAVING count(DISTINCT source) >= 2 ORDER BY units DESC, occurrences DESC, body LIMIT 50""")
def repeated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("body"))
    return ot.repeated_phrases(lines, "source", "body")


@query()
def html_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every page; an HTML parser is beyond SQL."""
    return table(spark, sf, "pages").select("page_id", files.html_text("html").alias("text")).select("page_id", "text", F.length("text").alias("chars"))


_CATEGORY_RULES = [("metalwork", "ring|bolt"), ("toys", "widget|gadget")]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)ring|bolt') THEN 'metalwork' WHEN regexp_matches(p_name, '(?i)widget|gadget') THEN 'toys' ELSE 'other' END AS category, regexp_matches(p_name, '(?i)red') AS is_red, regexp_matches(p_name, '(?i)small') AS is_small FROM part")
def title_features(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", ft.classify(name, _CATEGORY_RULES, "other").alias("category"), *ft.features(name, {"is_red": "red", "is_small": "small"}))


@query("SELECT conv_id, turn, 'fallback:' || sha256(role || '|' || turn || '|t|' || text) AS message_key FROM conversations")
def message_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = ft.message_key(F.lit(None).cast("string"), F.col("role"), F.col("turn"), F.lit("t"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", key.alias("message_key"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '', 'g') AS title FROM documents")
def compact_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ft.compact_title(F.col("text")).alias("title"))


@query("""SELECT o_orderkey, o_totalprice AS number, CAST(o_orderdate AS DATE) AS day, TRUE AS no_number, TRUE AS no_day FROM orders""")
def lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with thousands commas and dates with slashes, read back; NaN text and the 30th of February are not values."""
    o = table(spark, sf, "orders")
    number = ty.lenient_number(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    return o.select("o_orderkey", number.alias("number"), ty.lenient_date(F.date_format("o_orderdate", "yyyy/M/d")).alias("day"), ty.lenient_number(F.lit("nan")).isNull().alias("no_number"), ty.lenient_date(F.lit("2026-02-30")).isNull().alias("no_day"))


# sampling

_PART = "SELECT p_partkey, p_type, p_brand, p_retailprice FROM part"


@query("""WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), g AS (SELECT p_type, row_number() OVER (ORDER BY n DESC, p_type) AS g FROM s), r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS t FROM part)
    SELECT p_partkey, p_type FROM r JOIN g USING (p_type) ORDER BY t, g LIMIT 37""")
def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"], ["p_partkey"], 37).select("p_partkey", "p_type")


@query()
def sample_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Turns over brands with the cursor reset, which depends on the picks before."""
    return sampling.balanced(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], 60)


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey FROM r WHERE i IN (SELECT CAST(round_even(k * (SELECT count(*) - 1 FROM part) / 24.0, 0) AS BIGINT) FROM range(25) t(k))""")
def sample_even(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], 25)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice, CASE WHEN i <= 10 THEN 'high' WHEN i > n - 10 THEN 'low' ELSE 'middle' END AS band FROM r WHERE i <= 10 OR i > n - 10 OR i = n // 2 + 1""")
def sample_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.contrast(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 21)


@query("SELECT doc_id, lang, source, CAST(floor((row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 8)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 <> 0) WHERE k <= 5""")
def sample_next_batch(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.next_batch(docs, docs.filter("doc_id % 3 = 0"), "doc_id", ["lang"], ["doc_id"], 5)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1|' || doc_id)) AS k FROM documents) WHERE k <= 6""")
def sample_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "documents").select("doc_id", "lang"), F.col("doc_id"), "s1", 6, ["lang"])


@query("""WITH r AS (SELECT quality, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS position FROM (SELECT quality, list(doc_id % 50 ORDER BY doc_id) AS refs FROM labels GROUP BY 1)),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ref ORDER BY position, quality) = 1)
    SELECT ref, quality, position, CAST(row_number() OVER (ORDER BY position, quality) AS INTEGER) AS rank FROM f""")
def round_robin_refs(spark: SparkSession, sf: str) -> DataFrame:
    cards = table(spark, sf, "labels").groupBy("quality").agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d % 50).alias("refs"))
    return sampling.round_robin_references(cards, "quality", "refs").select("ref", "quality", F.col("position").cast("long"), "rank")


@query("""SELECT lang, source, count(*) AS eligible, count(*) FILTER (doc_id % 4 = 0) AS selected FROM documents GROUP BY ALL""")
def sample_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.coverage(docs, docs.filter("doc_id % 4 = 0"), ["lang", "source"])


# matching and sets


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def match_exact(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_name")
    return matching.exact_match(table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), c, ["key"]).select("o_orderkey", "c_name")


@query()
def near_title_match(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of even documents against those of odd ones of the same language and source."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", ft.normalize_title(F.substring_index("text", "\n", 1)).alias("title"))
    items, groups = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").select("lang", "source", F.col("doc_id").alias("other_id"), F.col("title").alias("other_title"))
    return matching.fuzzy_match(items, groups, ["lang", "source"], "doc_id", "title", "other_id", "other_title")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return matching.last_row_wins(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_customers(spark: SparkSession, sf: str) -> DataFrame:
    placed = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return matching.unmatched(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), placed, "key")


_SHEET_RULES = [("r_red", 2, "red"), ("r_blue", 2, "blue"), ("r_ring", 2, "ring"), ("r_any_small", 1, "small")]


@query("""WITH h AS (SELECT p_partkey, list_filter([CASE WHEN p_name LIKE '%red%' THEN {'p': 2, 'r': 'r_red'} END, CASE WHEN p_name LIKE '%blue%' THEN {'p': 2, 'r': 'r_blue'} END, CASE WHEN p_name LIKE '%ring%' THEN {'p': 2, 'r': 'r_ring'} END,
    CASE WHEN p_name LIKE '%small%' THEN {'p': 1, 'r': 'r_any_small'} END], lambda x: x IS NOT NULL) AS hits FROM part),
    t AS (SELECT p_partkey, list_filter(hits, lambda x: x.p = list_max(list_transform(hits, lambda y: y.p))) AS top FROM h)
    SELECT p_partkey, CASE WHEN len(top) = 1 THEN top[1].r END AS rule, CASE WHEN len(top) = 0 THEN 'unmatched' WHEN len(top) > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM t""")
def rule_join_parts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.rule_join(table(spark, sf, "part"), "p_partkey", "p_name", _SHEET_RULES)


@query("""SELECT o_orderkey, ref, CASE WHEN c_custkey IS NULL THEN 'unknown_reference' ELSE 'unverified_reference' END AS problem
    FROM (SELECT DISTINCT o_orderkey, o_custkey + 100 AS ref FROM orders) LEFT JOIN customer ON c_custkey = ref WHERE c_custkey IS NULL OR c_acctbal <= 0""")
def reference_check(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("ref"))
    evidence = table(spark, sf, "customer").select(F.col("c_custkey").alias("ref"), F.when(F.col("c_acctbal") > 0, "verified").otherwise("open").alias("state"))
    return matching.reference_check(wanted, "o_orderkey", "ref", evidence, "state")


@query("SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45")
def set_intersection_parts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("key", F.col("l_partkey"))
    return matching.set_intersection(lines.filter("l_returnflag = 'R'"), lines.filter("l_linestatus = 'F' and l_quantity > 45"), "key")


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_difference_parts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.set_difference(table(spark, sf, "part").withColumn("key", F.col("p_partkey")), table(spark, sf, "lineitem").filter("l_quantity > 49").withColumn("key", F.col("l_partkey")), "key")


@query("SELECT event_type AS key FROM events WHERE value > 5 EXCEPT ALL SELECT event_type FROM events WHERE value > 20")
def multiset_difference_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("key", F.col("event_type"))
    return matching.multiset_difference(e.filter("value > 5"), e.filter("value > 20"), "key")


@query("""WITH p AS (SELECT page_id, 'site/' || (page_id % 7) || '/a/' || page_id AS path FROM pages), r AS (SELECT unnest(['site', 'site/1', 'site/2/a']) AS root)
    SELECT path, root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) = 1""")
def deepest_root(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "pages").select(F.concat(F.lit("site/"), (F.col("page_id") % 7).cast("string"), F.lit("/a/"), F.col("page_id").cast("string")).alias("path"))
    return matching.deepest_root(paths, "path", spark.createDataFrame([("site",), ("site/1",), ("site/2/a",)], "root string"), "root")


# corpus


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: three formats, folders by source, versions by id."""
    suffix = F.element_at(F.array(F.lit("md"), F.lit("txt"), F.lit("pdf")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat("source", F.lit("/note"), F.floor(F.col("doc_id") / 6).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_v2").otherwise(""), F.lit("."), suffix)
    return table(spark, sf, "documents").select(path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.col("doc_id").alias("modified"))


_FILES_SQL = """f AS (SELECT source || '/note' || CAST(floor(doc_id / 6) AS BIGINT) || CASE WHEN doc_id % 2 = 0 THEN '_v2' ELSE '' END || '.' || ['md', 'txt', 'pdf'][doc_id % 3 + 1] AS path, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, doc_id AS modified FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN path LIKE '%.pdf' THEN path ELSE split_part(path, '/', 1) || '|' || regexp_replace(regexp_replace(split_part(path, '/', 2), '\\.[a-z]+$', ''), '[^a-z0-9]', '', 'g') END
        ORDER BY CASE regexp_extract(path, '([a-z]+)$', 1) WHEN 'md' THEN 1 WHEN 'txt' THEN 2 ELSE 99 END, lower(path), path) = 1 AS canonical FROM f),
    m AS (SELECT *, CASE WHEN canonical AND first_value(path) OVER w <> path THEN first_value(path) OVER w END AS duplicate_of FROM k WINDOW w AS (PARTITION BY sha256, canonical ORDER BY lower(path), path))"""


@query(f"WITH {_FILES_SQL} SELECT path, sha256, bytes, modified, canonical, duplicate_of FROM m")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.mark_canonical(_files(spark, sf))


@query(f"""WITH {_FILES_SQL} SELECT path, modified, bytes FROM m WHERE canonical AND duplicate_of IS NULL
    QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(split_part(path, '/', 2), '\\.[a-z]+$', ''), '_v2$', '') ORDER BY modified DESC, bytes DESC, path DESC) = 1""")
def version_families(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.family_representatives(corpus.mark_canonical(_files(spark, sf))).select("path", "modified", "bytes")


@query(f"""WITH {_FILES_SQL}, s AS (SELECT CASE WHEN path LIKE '%.pdf' THEN 'document' ELSE 'text_document' END AS container, regexp_extract(path, '([a-z]+)$', 1) AS suffix, * FROM m)
    SELECT container, suffix, CAST(grouping(container, suffix) AS BIGINT) AS level, count(*) AS files, count(*) FILTER (canonical) AS canonical_files, count(duplicate_of) AS duplicates FROM s GROUP BY GROUPING SETS ((container), (suffix), ())""")
def inventory_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.inventory_summary(corpus.mark_canonical(_files(spark, sf))).withColumn("level", F.col("level").cast("long"))


_ROLES = ("content_text", *corpus.FAMILIES, "archive", "")


@query(f"""WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN lang END AS business, {list(_ROLES)}[1 + CAST(doc_id % {len(_ROLES)} AS INTEGER)] AS role, source FROM documents),
    n AS (SELECT coalesce(nullif(business, ''), CASE WHEN role = 'content_text' THEN coalesce(nullif(source, ''), '{corpus.OTHER_TEXTS}') WHEN role = '' THEN '{corpus.FAMILIES["unclassified"]}'
        {" ".join(f"WHEN role = '{k}' THEN '{v}'" for k, v in corpus.FAMILIES.items())} ELSE role END) AS label FROM d)
    SELECT label, count(*) AS files FROM n GROUP BY 1""")
def family_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files with roles by id, counted by provisional family."""
    d = table(spark, sf, "documents").withColumn("role", F.get(F.array(*map(F.lit, _ROLES)), (F.col("doc_id") % len(_ROLES)).cast("int"))).withColumn("canonical", F.lit(None).cast("boolean"))
    return corpus.canonical_counts(d, corpus.provisional_family(F.when(F.col("doc_id") % 5 == 0, F.col("lang")), F.col("role"), F.col("source")), "unclassified")


@query("""WITH h AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS source FROM documents)
    SELECT 'edge-' || left(sha256('duplicate|' || source || '|' || doc_id), 16) AS edge_id, source, doc_id AS target, 'duplicate' AS kind FROM h WHERE source <> doc_id""")
def source_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.star_edges(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id", "duplicate", ["doc_id"])


@query("""WITH n AS (SELECT doc_id, sha256(text) AS s FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE s END AS s, CASE WHEN doc_id % 7 = 0 THEN 'p1' ELSE 'p2' END AS parser, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'complete' END AS st FROM n WHERE doc_id % 3 <> 0)
    SELECT CAST(n.doc_id AS VARCHAR) AS path, CASE WHEN b.s = n.s AND parser = 'p2' AND st = 'complete' THEN 'reuse' ELSE 'parse' END AS action,
    CASE WHEN b.s IS NULL THEN 'new_file' WHEN b.s <> n.s THEN 'content_changed' WHEN parser <> 'p2' THEN 'parser_changed' WHEN st <> 'complete' THEN 'previous_incomplete' ELSE 'unchanged' END AS reason FROM n LEFT JOIN b USING (doc_id)""")
def incremental_manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = d.select("path", "sha256", F.lit("p2").alias("parser"), F.lit("m1").alias("metrics"))
    before = d.filter("doc_id % 3 <> 0").select(
        "path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 7 == 0, "p1").otherwise("p2").alias("parser"), F.lit("m1").alias("metrics"),
        F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("complete").alias("status"),
    )
    return corpus.incremental_manifest(now, before)


@query("""SELECT o_orderpriority AS family, count(*) AS batches, bool_and(NOT fresh) AND count(*) = 2 AS stable FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY y DESC) AS k FROM (SELECT o_orderpriority, date_trunc('year', o_orderdate) AS y, max(o_totalprice) > 499000 AS fresh FROM orders GROUP BY ALL)) WHERE k <= 2 GROUP BY 1""")
def batch_stability(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.year("o_orderdate").alias("y")).agg((F.max("o_totalprice") > 499000).alias("fresh"))
    return sampling.two_batch_stability(done, "family", "y", "fresh")


# streaming


def _stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    schema = table(spark, sf, "events").schema
    return se.read_files(spark, sf, schema, "events.parquet"), scratch_dir(spark, "stream")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows of the event stream, closed by the watermark or the end, equal to the batch result."""
    events, place = _stream(spark, sf)
    out = se.tumbling(events, "ts", "1 day", "1 hour", ["event_type"], "value")
    se.ingest(out, f"{place}/out", f"{place}/checkpoint", "update")
    rows = se.latest(se.read_ingested(spark, f"{place}/out", out.schema), ["window_start", "event_type"])
    return rows.withColumn("total", F.round("total", 2)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    events, place = _stream(spark, sf)
    out = se.running_totals(events, "event_type", "value")
    se.ingest(out, f"{place}/out", f"{place}/checkpoint", "update")
    return se.latest(se.read_ingested(spark, f"{place}/out", out.schema), ["event_type"]).withColumn("total", F.round("total", 2))
