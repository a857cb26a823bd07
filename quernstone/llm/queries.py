"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorization, langid, linededup, mixing, packing, ppm, quality, sharding, shingles, topk, txlog, urlfilter, variants
from .common import id_remainder, scratch_dir, table


def tokenizer_path() -> str:
    """The public tokenizer file that op1 uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_report(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    return langid.identify(docs, langid.train(docs.filter(~held_out)), held_out)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = id_remainder("doc_id", 4) == 2
    return factorization.score(docs, factorization.train(docs, labels.filter(~held_out)), held_out)


#: The production mix: what each domain, language and source should weigh.
MIX_TREE = mixing.MixTree(
    domain_weights={"web": 0.5, "books": 0.3, "reference": 0.2},
    domain_sources={"web": [f"src{n}" for n in range(5)], "books": [f"src{n}" for n in range(5, 12)], "reference": [f"src{n}" for n in range(12, 20)]},
    language_weights={"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    source_weights={"src0": 2.0},
)
MIX_SHARE = 0.8
MIX_EPOCHS = 2
MIX_SEED = 2024


def mix_documents(docs: DataFrame) -> DataFrame:
    return mixing.mix_sources(docs, MIX_TREE, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("row.doc_id", "domain", "language", "origin", "n_tokens", "epoch")


ARRIVALS = 8


def op8_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches, each is appended and the store compacted; every row with its shard at the end."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}")
    arrival = id_remainder("doc_id", ARRIVALS)
    for k in range(ARRIVALS):
        store.append(docs.filter(arrival == k))
        store.compact()
        store.vacuum()
    return store.read_placed().select("row.doc_id", F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"), "shard", "tier", "version")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


#: One in so many runs, by its crc32, loses a letter.
DAMAGE = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.word_counts(table(spark, sf_dir, "documents"), damage=DAMAGE))


LOG_KEYS = 300
COMMITS_PER_EPOCH = 4


def document_log(docs: DataFrame) -> DataFrame:
    """Documents read as log records: (seq, source, kind, key, value)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bounds = {"commit": 1, "abort": 2, "savepoint": 4, "rollback": 6, "change": 22}
    kind = F.coalesce(*(F.when(h % 23 <= last, F.lit(name)) for name, last in bounds.items()))
    return docs.select(F.col("doc_id").alias("seq"), "source", kind.alias("kind"), (F.floor(h / 100) % LOG_KEYS).alias("key"), F.col("text").alias("value"))


def op12_transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("seq"))
    found = txlog.reassemble(document_log(table(spark, sf_dir, "documents")), COMMITS_PER_EPOCH, deletions=toxic)
    stored = F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("value")).cast("binary"))
    states = txlog.store_after_epochs(found, stored)
    states = states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").alias("n"), F.col("total").alias("value"))
    return states.unionByName(found.undone.select(F.col("reason").alias("kind"), F.col("seq").alias("id"), F.col("undone_by").alias("n"), F.col("key").alias("value")))


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark, URL_RULES))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_size_tiered_shards": op8_size_tiered_shards,
    "op9_exact_topk": op9_exact_topk,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_transaction_log": op12_transaction_log,
    "op13_url_filters": op13_url_filters,
}

def _mix_sql() -> str:
    """Op7 in SQL: the level of every set of siblings in closed form, then running sums by the epochs' order."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    domain = " ".join(f"WHEN source IN ({quoted(v)}) THEN '{k}'" for k, v in MIX_TREE.domain_sources.items())
    listed = quoted(x for v in MIX_TREE.domain_sources.values() for x in v)
    weight = lambda column, weights: "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" WHEN '{mixing.OTHER}' THEN {MIX_TREE.other_weight} ELSE 1.0 END::DOUBLE"

    def fill(name: str, nodes: str, parent: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY c / w, name"
        return f"""{name}_o AS (SELECT *, row_number() OVER ({order}) AS k, b - coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wt FROM ({nodes})),
            {name}_u AS (SELECT {parent}, min(k) AS fk, arg_min(lft / wt, k) AS lam FROM {name}_o WHERE c > lft / wt * w GROUP BY {parent}),
            {name} AS (SELECT o.*, CASE WHEN fk IS NULL OR k < fk THEN c ELSE lam * w END AS given FROM {name}_o o LEFT JOIN {name}_u u USING ({parent}))"""

    return f"""
        WITH d AS (SELECT doc_id, CASE {domain} ELSE '{mixing.OTHER}' END AS domain, CASE WHEN lang IN ({quoted(MIX_TREE.language_weights)}) THEN lang ELSE '{mixing.OTHER}' END AS language,
                CASE WHEN source IN ({listed}) THEN source ELSE '{mixing.OTHER}' END AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
        leaves AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS n, sum(n_tokens) * {MIX_EPOCHS}.0::DOUBLE AS c FROM d GROUP BY ALL),
        {fill("f1", f"SELECT 0 AS root, domain, domain AS name, sum(c) AS c, {weight('domain', MIX_TREE.domain_weights)} AS w, (SELECT least(sum(n) * {MIX_SHARE}::DOUBLE, sum(c)) FROM leaves) AS b FROM leaves GROUP BY domain", "root")},
        {fill("f2", f"SELECT l.domain, language, language AS name, sum(l.c) AS c, {weight('language', MIX_TREE.language_weights)} AS w, any_value(given) AS b FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, language", "domain")},
        {fill("f3", f"SELECT l.domain || '/' || l.language AS parent, l.domain, l.language, origin, origin AS name, l.c, l.n, {weight('origin', MIX_TREE.source_weights)} AS w, given AS b FROM leaves l JOIN f2 ON f2.domain = l.domain AND f2.language = l.language", "parent")},
        plan AS (SELECT domain, language, origin, CASE WHEN n = 0 THEN {MIX_EPOCHS} ELSE CAST(floor(given + 1e-6) AS BIGINT) // n END AS epochs, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(given + 1e-6) AS BIGINT) % n END AS rest FROM f3),
        e AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, language, origin, epoch ORDER BY md5(doc_id || '|{MIX_SEED}|' || epoch), doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, epoch
            FROM d JOIN plan USING (domain, language, origin), range({MIX_EPOCHS}) t(epoch))
        SELECT doc_id, domain, language, origin, n_tokens, CAST(epoch AS INTEGER) AS epoch FROM e WHERE epoch < epochs OR (epoch = epochs AND upto <= rest)
    """


def _url_sql() -> str:
    """Op13 in SQL: every rule is tried on every url, the longest fitting one wins."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
        WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT k, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
            FROM (SELECT k, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u)),
        r(verdict, host, path) AS (VALUES {rules}),
        f AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (k)
    """


ORACLE_SQL: dict[str, str] = {
    "op7_source_mixing": _mix_sql(),
    "op13_url_filters": _url_sql(),
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(CASE WHEN len(q.x) = 0 OR len(c.x) = 0 THEN 0 ELSE list_inner_product(q.x, c.x) END AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
