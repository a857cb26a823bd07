"""Registered queries of the media operators and of more scalar functions, on tables that stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import types as ty
from ..operators import corpus, matching, media, operational, sampling
from ..session import table
from .catalog import FIRST, SECOND, query


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pages of orders: quantity is the width, the price the height."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 20).alias("width"), F.col("l_extendedprice").alias("height")).dropDuplicates(["path", "page"])


_PAGES_SQL = """pg AS (SELECT l_orderkey AS path, l_linenumber AS page, any_value(l_quantity) * 20 AS width, any_value(l_extendedprice) AS height FROM lineitem GROUP BY ALL HAVING count(*) = 1),
    md AS (SELECT path, median(height) AS mh FROM pg GROUP BY 1),
    ge AS (SELECT pg.path, page, width, height, height >= 2000 OR height / width >= 4 OR height >= 2.5 * mh AS long,
        coalesce(abs(width - lag(width) OVER w) > 5 OR abs(height - lag(height) OVER w) > 5, false) AS changed FROM pg JOIN md ON md.path = pg.path WINDOW w AS (PARTITION BY pg.path ORDER BY page))"""


def _single_pages(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page")).count().filter("count = 1").drop("count")
    return _pages(spark, sf).join(keys, ["path", "page"])


@query(f"WITH {_PAGES_SQL} SELECT path, page, width, height, long, changed FROM ge")
def page_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return media.page_geometry(_single_pages(spark, sf))


@query(f"""WITH {_PAGES_SQL}, u AS (SELECT path, count(*) AS pages, avg(long::INT) AS s FROM ge GROUP BY 1)
    SELECT path, pages, CASE WHEN s >= 0.5 THEN 'provisional_page_units' WHEN pages > 1 THEN 'internal_units_unresolved' ELSE 'single_page_source' END AS status, CASE WHEN s >= 0.5 OR pages = 1 THEN pages ELSE -1 END AS provisional_units FROM u""")
def page_units(spark: SparkSession, sf: str) -> DataFrame:
    return media.page_units(media.page_geometry(_single_pages(spark, sf))).na.fill(-1, ["provisional_units"])


@query("""WITH i AS (SELECT user_id AS article, event_id AS number, event_type AS sha256 FROM events), l AS (SELECT article, arg_max(sha256, number) AS last FROM i GROUP BY 1),
    d AS (SELECT i.*, last, max(CASE WHEN sha256 <> last THEN number END) OVER (PARTITION BY i.article) AS cut FROM i JOIN l ON l.article = i.article),
    r AS (SELECT article, sha256, count(*) AS run FROM d WHERE cut IS NULL OR number > cut GROUP BY ALL HAVING count(*) >= 2)
    SELECT sha256, count(*) AS articles, CAST(sum(run) AS BIGINT) AS occurrences FROM r GROUP BY 1 HAVING count(*) >= 2 AND sum(run) >= 4""")
def fixed_endings(spark: SparkSession, sf: str) -> DataFrame:
    return media.fixed_endings(table(spark, sf, "events").select(F.col("user_id").alias("article"), F.col("event_id").alias("number"), F.col("event_type").alias("sha256")))


def _mapped_images(o: DataFrame) -> DataFrame:
    """Customers as articles, their orders as references and, nine of ten, as images."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    refs = o.select(F.col("o_custkey").alias("article"), at.alias("position"), F.when(F.col("o_orderkey") % 3 == 0, 0.5).otherwise(2.0).alias("ratio"))
    images = o.filter("o_orderkey % 10 <> 0").select(F.col("o_custkey").alias("article"), F.col("o_orderkey").alias("number"), F.lit(100).alias("width"), F.when(F.col("o_orderkey") % 2 == 0, 50).otherwise(200).alias("height"))
    return media.map_images(refs, images).withColumn("position", F.col("position").cast("long")).na.fill(-1, ["number"])


@query("""WITH r AS (SELECT o_custkey AS article, row_number() OVER w AS position, count(*) OVER (PARTITION BY o_custkey) AS refs, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 2.0 END::DOUBLE AS ratio FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    i AS (SELECT o_custkey AS article, o_orderkey AS number, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 2.0 END::DOUBLE AS shape, row_number() OVER w AS position, count(*) OVER (PARTITION BY o_custkey) AS images FROM orders WHERE o_orderkey % 10 <> 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT r.article, r.position, coalesce(number, -1) AS number, CASE WHEN number IS NULL THEN 'missing_local' WHEN images <> refs THEN 'count_mismatch' WHEN abs(shape - ratio) <= 0.02 THEN 'order_and_ratio' ELSE 'ratio_conflict' END AS status
    FROM r LEFT JOIN i ON i.article = r.article AND i.position = r.position""")
def image_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped_images(table(spark, sf, "orders"))


@query("""WITH r AS (SELECT user_id AS path, event_type, round(avg(value), 3) AS mean_confidence, count(*) AS characters FROM events GROUP BY ALL)
    SELECT path, event_type AS mode, mean_confidence, characters, round(mean_confidence * least(1.0, characters / 20), 1) AS score FROM r
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY mean_confidence * least(1.0::DOUBLE, characters / 20) DESC, characters DESC, event_type) = 1""")
def best_ocr_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("path"), F.col("event_type").alias("mode")).agg(ty.scaled_round(F.avg("value"), 3).alias("mean_confidence"), F.count(F.lit(1)).alias("characters"))
    # rounded once: four digits first would lift 0.04996 to 0.1
    return media.best_ocr_run(runs).withColumn("score", ty.scaled_round(media.ocr_score(), 1))


@query()
def media_spread_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in turns over hosts, each host in breadth-first middles."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return media.spread_sample(pages, ["host"], ["page_id"], 40)


@query()
def transcript_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as speech segments, through the JSON reader."""
    seg = F.struct((F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1).alias("end"), "text", F.lit(-0.5).alias("avg_logprob"), F.when(F.col("turn") % 4 == 3, 0.9).otherwise(0.1).alias("no_speech_prob"))
    files = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("path")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(seg)).alias("segments"))).alias("text"))
    return media.transcript_screen(media.transcript_segments(files))


@query("""SELECT doc_id, CASE WHEN instr(text, '. ') = 0 THEN trim(text) ELSE trim(split_part(substr(text, instr(text, '. ') + 2), chr(10), 1)) END AS body,
    CASE WHEN instr(text, '. ') = 0 THEN 'no_start' WHEN instr(substr(text, instr(text, '. ') + 2), chr(10)) = 0 THEN 'no_end' ELSE 'bounded' END AS status FROM documents""")
def article_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Text between the first full stop and the next line end."""
    return media.article_bodies(table(spark, sf, "documents"), "doc_id", ". ", "\n")


@query(f"""SELECT conv_id, turn, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(trim(text), '(?i){p}') THEN '{n}' END" for n, p in ft.CUES.items())}) AS cues FROM conversations""")
def cue_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(ft.cue_tags(F.col("text")), ",").alias("cues"))


@query("""SELECT doc_id, len(regexp_extract_all('# ' || text, '(?m)^#{1,6}\\s')) AS headings, len(regexp_extract_all(text, '\\*\\*')) // 2 AS bold_pairs, length(regexp_replace(regexp_replace('# ' || text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '[#*`>\\s]', '', 'g')) AS visible_chars FROM documents""")
def markdown_figures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *ft.markdown_figures(F.concat(F.lit("# "), "text"))).select("doc_id", "headings", "bold_pairs", "visible_chars")


_PATH = "source || '/2024-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) || '/Plan' || (doc_id % 40) || CASE doc_id % 4 WHEN 0 THEN '_v2' WHEN 1 THEN ' copy' WHEN 2 THEN ' (3)' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PNG' ELSE '.md' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text_document' END AS container, 'plan' || (doc_id % 40) AS family, split_part(path, '/', 1) AS top_folder,
    '2024-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS collected, 'src-' || left(sha256(path), 12) AS container_id FROM p""")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    mark = F.element_at(F.array(F.lit("_v2"), F.lit(" copy"), F.lit(" (3)"), F.lit("")), (i % 4 + 1).cast("int"))
    end = F.element_at(F.array(F.lit(".csv"), F.lit(".PNG"), F.lit(".md")), (i % 3 + 1).cast("int"))
    path = F.concat("source", F.lit("/2024-0"), (i % 9 + 1).cast("string"), F.lit("-1"), (i % 10).cast("string"), F.lit("/Plan"), (i % 40).cast("string"), mark, end)
    p = d.select("doc_id", path.alias("path"))
    c = F.col("path")
    return p.select("doc_id", corpus.container_type(c).alias("container"), corpus.family_stem(c).alias("family"), corpus.top_folder(c).alias("top_folder"), corpus.collection_date(c).alias("collected"), ft.stable_id("src-", 12, c).alias("container_id"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end, o_orderstatus = 'F' AS done, '__MISSING__' AS blank FROM orders")
def temporal_bounds(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    done = ty.truthy(F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("no"))
    return table(spark, sf, "orders").select("o_orderkey", ty.iso_date(day).alias("day"), ty.temporal(day, end_of_day=True).alias("day_end"), done.alias("done"), ty.group_key(F.lit("  ")).alias("blank"))


@query(f"""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{FIRST.start}' AND DATE '{FIRST.end}' THEN '{FIRST.id}' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{SECOND.start}' AND DATE '{SECOND.end}' THEN '{SECOND.id}' END AS period FROM orders""")
def period_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", operational.period_of(F.to_date("o_orderdate"), [FIRST, SECOND]).alias("period"))


def _order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Three days from every order's date."""
    return table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 2).alias("e"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey AS k, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 2, INTERVAL 1 DAY))::DATE AS day FROM orders)
    SELECT a.o_custkey, a.day, max(a.k) AS first, b.k AS second FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.day = b.day AND a.k < b.k GROUP BY a.o_custkey, a.day, b.k""")
def interval_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer whose three days meet."""
    return matching.overlapping_intervals(_order_intervals(spark, sf), "k", "s", "e", ("o_custkey",))


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def ordered_distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_occurrences(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 10 = 3")
def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    return corpus.removed_files(d.filter("doc_id % 10 <> 3"), d)


@query("""WITH f AS (SELECT 'shots/c' || client_id % 40 || '/Screenshot_' || strftime(sold_at, '%Y-%m-%d_%H%M%S') || '.png' AS path, 'shots/c' || client_id % 40 || '|' || strftime(sold_at, '%Y-%m-%d|%H') AS k FROM sales WHERE sold_at IS NOT NULL AND client_id IS NOT NULL
    UNION SELECT 'Scans/' || source || '/Notes ' || stamp_id % 7 || '-page ' || stamp_id || '.jpg', 'scans/' || source || '|page|notes' || stamp_id % 7 FROM stamps WHERE source IS NOT NULL UNION SELECT 'cover/' || source || stamp_id % 90 || '.png', 'cover' || source || stamp_id % 90 FROM stamps WHERE source IS NOT NULL),
    u AS (SELECT k, arg_min(path, (lower(path), path)) AS unit, count(*) AS members FROM f GROUP BY k) SELECT path, unit, members FROM f JOIN u USING (k)""")
def capture_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Screenshots named by the moments of sales, numbered scans and covers, as units."""
    sales = table(spark, sf, "sales").filter("sold_at IS NOT NULL AND client_id IS NOT NULL")
    stamps = table(spark, sf, "stamps").filter("source IS NOT NULL")
    word = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    shots = sales.select(F.concat(F.lit("shots/c"), word(F.col("client_id") % 40), F.lit("/Screenshot_"), F.date_format("sold_at", "yyyy-MM-dd_HHmmss"), F.lit(".png")).alias("path"))
    pages = stamps.select(F.concat(F.lit("Scans/"), "source", F.lit("/Notes "), word(F.col("stamp_id") % 7), F.lit("-page "), word("stamp_id"), F.lit(".jpg")).alias("path"))
    covers = stamps.select(F.concat(F.lit("cover/"), "source", word(F.col("stamp_id") % 90), F.lit(".png")).alias("path"))
    return corpus.capture_units(shots.unionByName(pages).unionByName(covers))
