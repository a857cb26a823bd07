"""Names that are prefixes of each other, and phrases inside texts: joins without comparing all pairs.

A prefix join expands the names of one side into all their prefixes, with what is
needed of each already aggregated, and meets the other side by equality. So a short
name that many others begin with is one row, and no range is compared with another.
Both sides are shuffled: Spark takes the expanded rows for as many as the names, and
would send them through the driver to be broadcast.
Phrases are looked for by automata that read every text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_slices

LEAD = "_lead"


def _prefixes(name: Column) -> Column:
    """All prefixes of name but itself, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.char_length(name) - 1), lambda k: F.substr(name, F.lit(1), k))


def _expanded(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and lead: a row for each proper prefix of name."""
    return df.filter(F.char_length(name) > 0).withColumn(LEAD, F.explode(_prefixes(F.col(name))))


def _shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """left joined with right, neither of which is broadcast, whatever sizes Spark expects."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def match_directories(articles: DataFrame, directories: DataFrame, keys: list[str], article: str, title: str, directory: str, name: str) -> DataFrame:
    """article, directory and match (exact_title, prefix_title, ambiguous or unmatched) of every article.

    An article belongs to the directory of the same name; else to the one whose name
    is a prefix of its title or begins with it, the longest common part first, and of
    equally long ones the first name in order. Two directories of the chosen name are
    ambiguous. keys, title and name are compared as they are: normalise them before.

    Names that begin with a title share all of it, more than any that the title
    begins with: so the three cases are tried in turn, each by equality, over one row
    for each different name.
    """
    names = directories.groupBy(*keys, F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_times"), F.min(directory).alias("_directory"))
    wanted = articles.select(*keys, article, F.col(title).alias("_title")).distinct()
    titles = wanted.select(*keys, "_title").distinct()
    best = lambda order: F.min_by(F.struct("_name", "_times", "_directory"), order)
    # names beginning with the title: the first of them in order
    longer = _expanded(names, keys, "_name").groupBy(*keys, F.col(LEAD).alias("_title")).agg(best(F.col("_name")).alias("_longer"))
    # names that the title begins with: the longest; its prefixes meet the names by equality
    shorter = _shuffled(_expanded(titles, keys, "_title"), names.withColumnRenamed("_name", LEAD), [*keys, LEAD], "inner").groupBy(*keys, "_title")
    shorter = shorter.agg(F.max_by(F.struct(F.col(LEAD).alias("_name"), "_times", "_directory"), F.char_length(LEAD)).alias("_shorter"))
    same = names.select(*keys, F.col("_name").alias("_title"), F.struct("_name", "_times", "_directory").alias("_same"))
    by = [*keys, "_title"]
    for part in (same, longer, shorter):
        wanted = _shuffled(wanted, part, by, "left")
    found = wanted.withColumn("_best", F.coalesce("_same", "_longer", "_shorter"))
    clear = F.col("_best._times") == 1
    match = F.when(F.col("_best").isNull(), "unmatched").when(~clear, "ambiguous").when(F.col("_same").isNotNull(), "exact_title").otherwise("prefix_title")
    return found.select(article, F.when(clear, F.col("_best._directory")).alias(directory), match.alias("match"))


def match_covers(articles: DataFrame, covers: DataFrame, keys: list[str], article: str, title: str, cover: str, name: str) -> DataFrame:
    """article, cover and candidates of every article: the one cover whose name equals its title, begins with it or begins it; null if there isn't exactly one."""
    # covers are counted by name, so that a frequent name is one row
    names = covers.groupBy(*keys, F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_times"), F.min(cover).alias("_cover"))
    wanted = articles.select(*keys, article, F.col(title).alias("_title")).distinct()
    titles = wanted.select(*keys, "_title").distinct()
    figures = [F.sum("_times").alias("_times"), F.min("_cover").alias("_cover")]
    longer = _expanded(names, keys, "_name").groupBy(*keys, F.col(LEAD).alias("_title")).agg(*figures)
    shorter = _shuffled(_expanded(titles, keys, "_title"), names.withColumnRenamed("_name", LEAD), [*keys, LEAD], "inner").groupBy(*keys, "_title").agg(*figures)
    same = names.select(*keys, F.col("_name").alias("_title"), "_times", "_cover")
    by = [*keys, "_title"]
    all_ = same.unionByName(longer).unionByName(shorter).groupBy(*by).agg(*figures)
    found = _shuffled(wanted, all_, by, "left")
    return found.select(article, F.when(F.col("_times") == 1, F.col("_cover")).alias(cover), F.coalesce("_times", F.lit(0)).alias("candidates"))


#: Phrases of one automaton.
SLICE = 200_000


def contained_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    """(key, phrase_id, times, first): each phrase that a text contains, how often (overlaps count) and where first, in characters from 0.

    Phrases are dealt by hash into slices of about SLICE, each of which is an automaton
    that reads every text once; so the texts are read once for each SLICE phrases, and
    phrases are broadcast in pieces of bounded number. Equal phrases are found for each
    of their ids. Empty and null phrases are in no text, null texts contain none.
    """
    import ahocorasick

    spark = texts.sparkSession
    own = phrases.filter(F.coalesce(F.char_length(phrase), F.lit(0)) > 0).select(F.col(phrase_id).alias("_id"), F.col(phrase).alias("_phrase"))
    distinct = own.select("_phrase").distinct()
    slices = max(1, -(-distinct.count() // SLICE))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for k in range(slices):
        words = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("_phrase"), F.lit(slices)) == k).toLocalIterator()]
        shared = spark.sparkContext.broadcast(words)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in shared.value:
                automaton.add_word(w, w)
            if shared.value:
                automaton.make_automaton()
            for batch in (part for whole in batches for part in bounded_slices(whole, 1)):
                rows: list[tuple] = []
                for owner, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    seen: dict[str, list[int]] = {}
                    for end, w in automaton.iter(body) if body and shared.value else ():
                        seen.setdefault(w, [0, end - len(w) + 1])[0] += 1
                    rows += [(owner.as_py(), w, *x) for w, x in seen.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["_key", "_phrase", "times", "first"])

        part = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(find, f"_key {kind}, _phrase string, times long, first long")
        out = part if out is None else out.unionByName(part)
    return out.join(own, "_phrase").select(F.col("_key").alias(key), F.col("_id").alias(phrase_id), "times", "first")


def coverage_review(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """items (review, position, source_locator, baseline_text) with problem: incomplete_item, absent_from_baseline or null.

    baseline (text) holds every text of the baseline; both sides are compared trimmed, by equality.
    """
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    known = baseline.select(trimmed(F.col("text")).alias("_text")).filter("_text <> ''").distinct().withColumn("_known", F.lit(True))
    found = items.withColumn("_text", trimmed(F.col("baseline_text"))).join(known, "_text", "left")
    incomplete = (F.col("_text") == "") | (trimmed(F.col("source_locator")) == "")
    return found.select(*items.columns, F.when(incomplete, "incomplete_item").when(F.col("_known").isNull(), "absent_from_baseline").alias("problem"))
