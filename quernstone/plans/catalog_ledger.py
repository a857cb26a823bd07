"""Registered queries over ledgers of findings, names, phrases and locators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, compact_title
from ..functions.types import exact_sum
from ..operators import evidence, increments, prefixes, smooth, verification
from ..session import table
from .catalog import query

_MONTHS = [f"{y}-{m:02d}" for y in range(1993, 1998) for m in range(1, 13)]
#: kind, and what measures it in SQL
_MONTHLY = {
    "count": "CAST(count(*) AS DOUBLE)", "sum": "sum(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "mean": "avg(o_totalprice)", "median": "median(o_totalprice)",
    "proportion": "avg(CAST(o_totalprice > 150000 AS INTEGER))", "date_of_max": "strftime(arg_max(o_orderdate, (o_totalprice, -epoch(o_orderdate))), '%Y-%m-%d')",
    "group_mean_difference": "avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (o_orderpriority = '5-LOW')",
}


def _month_findings() -> list[dict]:
    figures = {
        "proportion": {"condition": {"operator": "gt", "value": 150000}}, "group_mean_difference": {"group_field": "o_orderpriority", "group_a": "1-URGENT", "group_b": "5-LOW"},
    }
    field = lambda kind: {} if kind == "count" else {"field": "o_totalprice"}
    end = lambda month: f"{month}-28"  # noqa: E731  a bare end date is the end of its day
    return [{"finding_id": f"{month} {kind}", "source": "orders", "measurement": {"kind": kind} | field(kind) | figures.get(kind, {}), "start": f"{month}-01", "end": end(month)} for month in _MONTHS for kind in _MONTHLY]


def _monthly_sql() -> str:
    """Every month's figures; the ledger states the counts one too high in every third month, and no medians."""
    parts = []
    for kind, sql in _MONTHLY.items():
        text = kind == "date_of_max"
        value, words = ("NULL", sql) if text else (sql, "NULL")
        n = "count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW'))" if kind.startswith("group") else "count(*)"
        stated = "CASE WHEN month(any_value(o_orderdate)) % 3 = 0 THEN count(*) + 1.0 ELSE count(*) END" if kind == "count" else "NULL" if kind == "median" else value
        verdict = {"count": "CASE WHEN month(any_value(o_orderdate)) % 3 = 0 THEN 'differs' ELSE 'confirmed' END", "median": "'unstated'"}.get(kind, f"CASE WHEN {value if not text else words} IS NULL THEN 'unstated' ELSE 'confirmed' END")
        parts.append(f"""SELECT strftime(o_orderdate, '%Y-%m') || ' {kind}' AS finding_id, 'orders' AS source, '{kind}' AS kind, round(CAST({value} AS DOUBLE), 4) AS value, CAST({words} AS VARCHAR) AS text, {n} AS n,
            CASE WHEN {value if not text else words} IS NULL THEN 'unverifiable' ELSE 'completed' END AS status, {verdict} AS verdict, round(CAST({stated} AS DOUBLE), 4) AS stated_value FROM o GROUP BY strftime(o_orderdate, '%Y-%m')""")
    return "WITH o AS (SELECT * FROM orders WHERE day(o_orderdate) <= 28 AND year(o_orderdate) BETWEEN 1993 AND 1997) " + " UNION ALL ".join(parts)


@query(_monthly_sql())
def ledger_reverification(spark: SparkSession, sf: str) -> DataFrame:
    """540 findings on the orders of sixty months, recomputed in one scan, against what a ledger states."""
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderdate", "o_orderpriority")
    within = orders.filter(F.dayofmonth("o_orderdate") <= 28).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    group = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    off = F.when(F.right("month", F.lit(2)).cast("int") % 3 == 0, 1).otherwise(0)
    price = F.col("o_totalprice")
    told = within.groupBy("month").agg(
        F.count(F.lit(1)).alias("count"), exact_sum(price).alias("sum"), F.min(price).alias("min"), F.max(price).alias("max"), F.avg(price).alias("mean"), F.avg((price > 150000).cast("double")).alias("proportion"),
        (group("1-URGENT") - group("5-LOW")).alias("group_mean_difference"), F.date_format(F.max_by("o_orderdate", F.struct(price, -F.unix_date(F.to_date("o_orderdate")))), "yyyy-MM-dd").alias("date"),
    ).withColumn("count", F.col("count") + off)
    figures = [k for k in _MONTHLY if k not in ("median", "date_of_max")]
    entry = lambda kind, value, text: F.struct(F.concat("month", F.lit(f" {kind}")).alias("finding_id"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    stated = told.select(F.inline(F.array(*(entry(k, F.col(k), F.lit(None)) for k in figures), entry("date_of_max", F.lit(None), F.col("date")))))
    found = verification.reverify({"orders": (orders, "o_orderdate")}, _month_findings(), stated, tolerance=1e-6)
    months = within.select(F.col("month")).distinct()
    # months without an order have no figures to verify
    kept = found.join(months, F.left("finding_id", F.lit(7)) == F.col("month"), "left_semi")
    return kept.select("finding_id", "source", "kind", F.round("value", 4).alias("value"), "text", "n", "status", "verdict", F.round("stated_value", 4).alias("stated_value"))


_COMPACT_SQL = "regexp_replace(lower(name), '[^a-z0-9\u4e00-\u9fff]+', '', 'g')"
#: Clients as articles, every second title cut short; their names, cut to 4 to 12 characters, as directories and covers.
_NAMES_SQL = f"""WITH a AS (SELECT client_id, nation_id, CASE WHEN client_id % 2 = 0 THEN {_COMPACT_SQL} ELSE left({_COMPACT_SQL}, 5) END AS t FROM clients),
    d AS (SELECT 'dir' || client_id AS dir, nation_id, left({_COMPACT_SQL}, CAST(4 + client_id % 9 AS INTEGER)) AS n FROM clients)"""


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    clients = table(spark, sf, "clients").withColumn("name", compact_title(F.col("name")))
    short = F.when(F.col("client_id") % 2 == 0, F.col("name")).otherwise(F.left("name", F.lit(5)))
    cut = F.substr(F.col("name"), F.lit(1), (F.col("client_id") % 9 + 4).cast("int"))
    return clients.select("client_id", "nation_id", short.alias("title")), clients.select(F.concat(F.lit("dir"), F.col("client_id").cast("string")).alias("dir"), "nation_id", cut.alias("name"))


@query(f"""{_NAMES_SQL},
    c AS (SELECT client_id, dir, n, CASE WHEN n = t THEN 3 ELSE 2 END AS grade, least(length(n), length(t)) AS shared FROM a JOIN d USING (nation_id) WHERE n = t OR starts_with(n, t) OR starts_with(t, n)),
    b AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY client_id, n) AS times FROM c WINDOW w AS (PARTITION BY client_id ORDER BY grade DESC, shared DESC, n, dir))
    SELECT a.client_id, CASE WHEN times = 1 THEN dir END AS dir, CASE WHEN dir IS NULL THEN 'unmatched' WHEN times > 1 THEN 'ambiguous' WHEN grade = 3 THEN 'exact_title' ELSE 'prefix_title' END AS match
    FROM a LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (client_id)""")
def directory_match(spark: SparkSession, sf: str) -> DataFrame:
    articles, directories = _names(spark, sf)
    return prefixes.match_directories(articles, directories, ["nation_id"], "client_id", "title", "dir", "name")


@query(f"""{_NAMES_SQL}, c AS (SELECT client_id, count(dir) AS candidates, min(dir) AS dir FROM a LEFT JOIN d ON d.nation_id = a.nation_id AND (n = t OR starts_with(n, t) OR starts_with(t, n)) GROUP BY 1)
    SELECT client_id, CASE WHEN candidates = 1 THEN dir END AS dir, candidates FROM c""")
def cover_match(spark: SparkSession, sf: str) -> DataFrame:
    articles, covers = _names(spark, sf)
    return prefixes.match_covers(articles, covers, ["nation_id"], "client_id", "title", "dir", "name")


@query("""WITH p AS (SELECT item_id * 1000 + k - 1 AS phrase_id, s[k] AS phrase FROM (SELECT item_id, list_transform(string_split_regex(text, '[.,]'), lambda x: trim(x)) AS s FROM benchmark), range(1, 1000) t(k) WHERE k <= len(s) AND length(s[k]) >= 3)
    SELECT doc_id, phrase_id, strpos(text, phrase) - 1 AS first FROM documents JOIN p ON contains(text, phrase)""")
def phrases_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every clause of the benchmark in every document."""
    clauses = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.,]")).alias("k", "phrase")).select((F.col("item_id") * 1000 + F.col("k")).alias("phrase_id"), F.trim("phrase").alias("phrase"))
    return prefixes.contained_phrases(table(spark, sf, "documents"), "doc_id", "text", clauses.filter(F.length("phrase") >= 3), "phrase_id", "phrase").select("doc_id", "phrase_id", "first")


@query("""SELECT client_id, CASE WHEN coalesce(trim(city), '') = '' OR coalesce(trim(email), '') = '' THEN 'incomplete_item' WHEN trim(city) NOT IN (SELECT trim(city) FROM client_changes WHERE city IS NOT NULL AND balance > 4000) THEN 'absent_from_baseline' END AS problem FROM clients""")
def baseline_coverage(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "clients").select("client_id", F.col("email").alias("source_locator"), F.col("city").alias("baseline_text"))
    baseline = table(spark, sf, "client_changes").filter("balance > 4000").select(F.col("city").alias("text"))
    return prefixes.coverage_review(items, baseline).select("client_id", "problem")


@query(f"""WITH d AS (SELECT 'L' || doc_id AS evidence_id, text, doc_id, string_split_regex(text, '{LINE_ENDS}') AS s FROM documents),
    l AS (SELECT evidence_id, doc_id, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS s FROM d),
    le AS (SELECT evidence_id, CASE WHEN 1 + doc_id % 3 > len(s) THEN 'locator_line_range_invalid' WHEN NOT contains(regexp_replace(array_to_string(s[1:1 + doc_id % 3], ''), '\\s+', '', 'g'),
        CASE WHEN doc_id % 2 = 0 THEN regexp_replace(left(s[1], 20), '\\s+', '', 'g') ELSE 'nowhereatall' END) THEN 'locator_quote_mismatch' END AS error FROM l),
    c AS (SELECT 'J' || click_id AS evidence_id, max(props) AS props, click_id FROM clicks WHERE click_id IS NOT NULL GROUP BY click_id),
    j AS (SELECT evidence_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '/device/os') AS VARCHAR) END AS v, props FROM c)
    SELECT * FROM le WHERE error IS NOT NULL
    UNION ALL SELECT 'L' || doc_id, 'source_sha256_mismatch' FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT 'L' || doc_id, 'directness_invalid' FROM documents WHERE lang = 'de'
    UNION ALL SELECT evidence_id, CASE WHEN props IS NULL THEN 'source_file_missing' WHEN v IS NULL THEN 'locator_unresolvable' ELSE 'locator_expected_mismatch' END FROM j WHERE props IS NULL OR v IS NULL OR v <> '"android"'""")
def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    """A card on the first lines of every document, and one on a JSON node of every click's properties."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias("content"), "text")
    clicks = table(spark, sf, "clicks").filter("click_id IS NOT NULL").groupBy("click_id").agg(F.max("props").alias("props")).withColumn("content", F.col("props").cast("binary"))
    said = [F.lit("seen").alias(c) for c in ("claim", "unit_id", "independence_group", "family_id", "lane")] + [F.lit(True).alias("verified")]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    first = F.get(F.split("text", LINE_ENDS, 2), F.lit(0))
    lines = docs.select(
        name("L", "doc_id").alias("evidence_id"), name("doc", "doc_id").alias("source"), *said, F.when(F.col("lang") == "de", "hearsay").otherwise("direct").alias("directness"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2("content", 256)).alias("source_sha256"), F.lit("line_range").alias("kind"), *none("string", "pointer", "expected"),
        F.lit(1).cast("long").alias("first"), (F.col("doc_id") % 3 + 1).alias("last"), F.when(F.col("doc_id") % 2 == 0, F.left(first, F.lit(20))).otherwise("nowhere at all").alias("quote"), *none("long", "row"),
    )
    nodes = clicks.select(
        name("J", "click_id").alias("evidence_id"), name("click", "click_id").alias("source"), *said, F.lit("derived").alias("directness"), F.sha2("content", 256).alias("source_sha256"),
        F.lit("json_pointer").alias("kind"), F.lit("/device/os").alias("pointer"), F.lit('"android"').alias("expected"), *none("long", "first", "last"), *none("string", "quote"), *none("long", "row"),
    )
    sources = docs.select(name("doc", "doc_id").alias("source"), "content").unionByName(clicks.select(name("click", "click_id").alias("source"), "content"))
    return evidence.card_errors(lines.unionByName(nodes), sources)


#: Three versions of clients' segments, by what happens to each id.
_VERSIONS_SQL = """WITH RECURSIVE b AS (SELECT DISTINCT client_id AS key, coalesce(segment, '') || client_id % 3 AS v FROM (SELECT client_id, max(segment) AS segment FROM clients GROUP BY 1)),
    o AS (SELECT key, CASE WHEN key % 7 = 0 THEN v || 'o' WHEN key % 17 = 0 THEN v || 's' ELSE v END AS v FROM b WHERE key % 11 <> 0), t AS (SELECT key, CASE WHEN key % 5 = 0 THEN v || 't' WHEN key % 17 = 0 THEN v || 's' ELSE v END AS v FROM b WHERE key % 13 <> 0),
    n AS (SELECT * FROM o UNION ALL SELECT DISTINCT -1 - key, 'new' FROM b WHERE key % 29 = 0), j AS (SELECT key, b.v AS bv, n.v AS ov, t.v AS tv FROM b FULL JOIN n USING (key) FULL JOIN t USING (key)),
    m AS (SELECT key, CASE WHEN bv IS NULL THEN 'added' WHEN ov IS NOT DISTINCT FROM bv AND tv IS NOT DISTINCT FROM bv THEN 'unchanged' WHEN ov IS NOT DISTINCT FROM tv THEN CASE WHEN ov IS NULL THEN 'removed' ELSE 'both' END
        WHEN tv IS NOT DISTINCT FROM bv THEN CASE WHEN ov IS NULL THEN 'removed' ELSE 'ours' END WHEN ov IS NOT DISTINCT FROM bv THEN CASE WHEN tv IS NULL THEN 'removed' ELSE 'theirs' END ELSE 'conflict' END AS state, bv, ov, tv FROM j)"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key, v = F.col("key"), F.col("v")
    base = table(spark, sf, "clients").groupBy(F.col("client_id").alias("key")).agg(F.max("segment").alias("v")).select("key", F.concat(F.coalesce("v", F.lit("")), (key % 3).cast("string")).alias("v"))
    changed = lambda n, mark: F.when(key % n == 0, F.concat(v, F.lit(mark))).when(key % 17 == 0, F.concat(v, F.lit("s"))).otherwise(v).alias("v")
    ours = base.filter("key % 11 <> 0").select("key", changed(7, "o")).unionByName(base.filter("key % 29 = 0").select((-1 - key).alias("key"), F.lit("new").alias("v")))
    return base, ours, base.filter("key % 13 <> 0").select("key", changed(5, "t"))


@query(f"{_VERSIONS_SQL} SELECT key, state, CASE WHEN state IN ('conflict', 'removed') THEN NULL WHEN state = 'theirs' THEN tv ELSE coalesce(ov, tv) END AS v FROM m")
def ledger_merge(spark: SparkSession, sf: str) -> DataFrame:
    return increments.merge_versions(*_versions(spark, sf), "key", ["v"])


@query(f"""{_VERSIONS_SQL}, g AS (SELECT item_id, CASE WHEN state IS NULL OR state = 'removed' THEN 2 WHEN state IN ('ours', 'theirs', 'both', 'conflict') THEN 1 ELSE 0 END AS grade FROM (SELECT DISTINCT item_id FROM items) LEFT JOIN m ON key = item_id * 3 % 1000),
    a AS (SELECT item_id, item_id AS up FROM g UNION ALL SELECT item_id, up // 4 FROM a WHERE up >= 100)
    SELECT CAST(a.item_id AS VARCHAR) AS increment_id, CASE max(coalesce(g.grade, 2)) WHEN 2 THEN 'dropped' WHEN 1 THEN 'reopened' ELSE 'kept' END AS outcome FROM a LEFT JOIN g ON g.item_id = a.up GROUP BY 1""")
def increment_rebase(spark: SparkSession, sf: str) -> DataFrame:
    """Items as increments: each rests on a client's entry, and from 100 on also on the item of a fourth of its number."""
    merged = increments.merge_versions(*_versions(spark, sf), "key", ["v"]).select(F.col("key").cast("string").alias("key"), "state")
    items = table(spark, sf, "items").select("item_id").distinct()
    own = items.select(F.col("item_id").cast("string").alias("increment_id"), (F.col("item_id") * 3 % 1000).cast("string").alias("on"), F.lit(False).alias("is_increment"))
    up = items.filter("item_id >= 100").select(F.col("item_id").cast("string").alias("increment_id"), F.floor(F.col("item_id") / 4).cast("string").alias("on"), F.lit(True).alias("is_increment"))
    return increments.rebase(own.select("increment_id"), own.unionByName(up), merged).select("increment_id", "outcome")


@query("""WITH s AS (SELECT epoch(date_trunc('day', o_orderdate)) / 86400 AS d, CAST(sum(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY 1), n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS k FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM s), l AS (SELECT regr_slope(value, d) AS b, regr_intercept(value, d) AS a FROM r, n WHERE i <= k)
    SELECT 'succeeded' AS status, n AS observed_rows, k AS training_rows, n - k AS holdout_rows, round(b, 4) AS slope, (SELECT round(avg(abs(value - a - b * d)), 2) FROM r, n, l WHERE i > k) AS linear_mae,
        (SELECT round(sqrt(avg(pow(value - a - b * d, 2))), 2) FROM r, n, l WHERE i > k) AS linear_rmse FROM n, l""")
def trend_line(spark: SparkSession, sf: str) -> DataFrame:
    """The straight line's side of the competition on daily sales; the curve's side is held against a dense fit in tests."""
    found = smooth.trend_competition(_daily_sales(spark, sf), "day", "value")
    return found.select("status", "observed_rows", "training_rows", "holdout_rows", F.round("slope", 4).alias("slope"), F.round("linear_mae", 2).alias("linear_mae"), F.round("linear_rmse", 2).alias("linear_rmse"))


@query()
def trend_competition(spark: SparkSession, sf: str) -> DataFrame:
    """Line against penalised spline; the penalty's choice is beyond SQL."""
    return smooth.trend_competition(_daily_sales(spark, sf), "day", "value")


def _daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))
