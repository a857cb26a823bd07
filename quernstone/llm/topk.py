"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights by term (dimension). For a block of candidates
the postings of each term are a list of rows and weights; a query scatters its
weight times those into a dense score array, term by term. Partition selection
keeps the k best of the block, and a merge keeps the k best of all blocks.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without an id; vectors of unequal length are sparse,
their missing terms weigh zero, and an empty one scores 0 with all. A query
never meets rows of its own id; repeated candidate rows each count. Equal scores
rank the smaller id first. No rows give no rows; other columns, of any name, are
ignored. Long vectors beside short ones cost what weights they have. Components so
large that a score might not fit into 64 bits raise OverflowError, which names the
most that fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Rows of a block of candidates and of queries, on average.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048

HIT_SCHEMA = "query_id long, vec_id long, score long"


def _weights(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every weight but zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return rows[some], terms[some], values[some]


def best_in_block(query_ids: np.ndarray, queries: pa.Array, ids: np.ndarray, vectors: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best vectors for each query."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    rows, terms, weights = _weights(vectors)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = place[rows]
    by_term = np.lexsort((rows, terms))
    rows, terms, weights = rows[by_term], terms[by_term], weights[by_term]
    known, starts = np.unique(terms, return_index=True)
    postings = {}
    for term, a, b in zip(known.tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True):
        postings[term] = (slice(None) if b - a == len(ids) else rows[a:b], weights[a:b])
    found = []
    scores = np.empty(len(ids), np.int64)
    worst = np.iinfo(np.int64).min
    asked, asked_terms, asked_weights = _weights(queries)
    cuts = np.searchsorted(asked, np.arange(len(query_ids) + 1)).tolist()
    for query_id, a, b in zip(query_ids.tolist(), cuts[:-1], cuts[1:], strict=True):
        scores[:] = 0
        for term, weight in zip(asked_terms[a:b].tolist(), asked_weights[a:b], strict=True):
            if term in postings:
                at, own_weights = postings[term]
                scores[at] += weight * own_weights
        own = slice(*np.searchsorted(ids, [query_id, query_id + 1]))
        scores[own] = worst
        n = min(k, len(ids) - (own.stop - own.start))
        if n <= 0:
            continue
        floor = np.partition(scores, len(scores) - n)[len(scores) - n]
        above = np.flatnonzero(scores > floor)
        ties = np.flatnonzero(scores == floor)
        ties = ties[(ties < own.start) | (ties >= own.stop)][: n - len(above)]  # ids ascend
        pick = np.r_[above, ties]
        found.append((np.full(len(pick), query_id), ids[pick], scores[pick]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row of vectors that is a query.

    vectors has vec_id and embedding. Each block of candidates meets each block of
    queries in one task; only k rows for each query and block are shuffled after.
    """
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    sound = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = (
        vectors.filter(whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), is_query.alias("asks"))
        .filter(sound)
    )
    largest = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    count, asked, top, terms = rows.agg(F.count(F.lit(1)), F.count_if("asks"), largest, F.max(F.size("x"))).first()
    if top and (top * scale + 1) * (top * scale + 1) * terms >= 2.0**63:
        raise OverflowError(f"components of {top:g} over {terms} terms have no score in 64 bits; {(2.0**63 / terms) ** 0.5 / scale:g} is the most")
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long")))
    blocks, query_blocks = -(-count // CANDIDATE_BLOCK) or 1, -(-asked // QUERY_BLOCK) or 1
    place = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "x", F.lit(False).alias("asks"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.filter("asks").select("vec_id", "x", "asks", every(blocks).alias("block"), F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"))

    def search(part: pa.Table) -> pa.Table:
        asking = part.filter(part.column("asks"))
        others = part.filter(pc.invert(part.column("asks")))
        lists = lambda rows: pa.concat_arrays(rows.column("x").chunks) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        hits = best_in_block(asking.column("vec_id").to_numpy(), lists(asking), others.column("vec_id").to_numpy(), lists(others), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, hits), strict=True)))

    hits = candidates.unionByName(queries).groupBy("block", "query_block").applyInArrow(search, HIT_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
