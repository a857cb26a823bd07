"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's set is its distinct words. A line goes if an earlier line, by doc_id,
hash of the whole text and line number, has a Jaccard similarity of PERCENT or
more to it; whether that earlier line is itself kept doesn't matter. Every line
with a word takes part; blank lines stay.

1. Lines of equal sets fall together: the first one stands for all. A set too small
   to match any but an equal one is settled by this alone.
2. Two sets that match differ in few words. Their words are dealt by hash into more
   parts than that, so some parts are equal in both. A line too few of whose parts
   are other lines' parts has no match and leaves the join here.
3. The words of the lines left are counted, in a table of fixed size by hash; the
   counts order each line's words, the rarest first. A word that is alone in its
   bucket and occurs once is unique, so it can't bring two lines together.
4. Similar lines share a word among their first ``n - ceil(t * n) + 1``. For every
   such word each line is held against the earliest one that has it, if length,
   position and the lines' other rare words allow the similarity; verified matches
   settle most lines of a large group of variants.
5. Lines not settled yet are held against all earlier ones that share such a
   word, again within these limits, and verified on whole sets.

Defined cases: null texts have no lines; rows without an id come first; rows that
share an id are told apart by their texts, and rows that share both are one; a
line can match another one of its own document; extra columns pass through. No
rows give no rows. Lines of every length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, whole_row

PERCENT = 90
#: Words beyond the prefix whose presence in the other line is looked at before verification.
WINDOW = 12
#: Buckets of the frequency table.
BUCKETS = 1 << 17
#: Bits of the filter by which documents without candidates are left out of a shuffle; full, it lets all pass.
FILTER_BITS = 1 << 20
#: Up to so many parts, each bound is looked up among the hashes; beyond, the bounds are read off in one pass.
LOOKED_UP = 16
#: Sizes that are dealt into the same number of parts: each class ends where its first size grows by half.
CLASS_GROWTH = 1.5

_NO_ID = -(1 << 63)
_LINE = ["doc", "version", "line"]
#: Range bounds are twice a number from minus this on, so that none overflows on the way.
_HALF = 1 << 62


def _spaced(text: Column) -> Column:
    """text with spaces for the other white space between words, but for line feeds."""
    spaced, there = text, F.lit(False)
    for mark in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
        there |= text.contains(mark)
    return F.when(there, spaced).otherwise(text)  # a look costs a fraction of a replacement that finds nothing


def _versions(docs: DataFrame, *more: Column) -> DataFrame:
    """doc (-2^63 for null ids) and version (hash of the whole text) name a text; with further columns."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("version"), *more)


def word_hashes(line: Column) -> Column:
    """The line's set, as hashes of its words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity_table(sets: DataFrame) -> str:
    """The frequency class of every bucket of words, separated by commas: 0 for a single occurrence, then fourths of a power of two."""
    words = sets.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(BUCKETS - 1).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    classes = sets.sparkSession.range(BUCKETS).join(counts, "id", "left").select("id", F.coalesce(F.least(F.lit(126), F.floor(F.log2("n") * 4)), F.lit(0)).alias("c"))
    # one row of a fixed size, whatever the input
    return classes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda x: x["c"].cast("string")), ",")).first()[0]


def by_rarity(words: Column, rarity: str) -> Column:
    """The set as integers: frequency class in the first byte, then 56 bits of the word's hash; ascending."""
    classes = F.split(F.lit(rarity), ",").cast("array<tinyint>")  # folded into a constant
    place = lambda h: F.get(classes, h.bitwiseAND(BUCKETS - 1).cast("int"))
    return F.sort_array(F.transform(words, lambda h: F.shiftleft(place(h).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _least(n: Column) -> Column:
    """The least overlap of a set of n words with any that matches."""
    return F.ceil(n * PERCENT / 100)


def _matches_others(n: Column) -> Column:
    """Whether a set of n words can match one that it doesn't equal."""
    return n * (100 - PERCENT) >= PERCENT


def _classes() -> list[tuple[int, int]]:
    """(sizes below this one, parts) of each class of sizes, up to the longest array there is."""
    out, first = [], -(-PERCENT // (100 - PERCENT))
    while first < 1 << 31:
        end = max(first + 1, int(first * CLASS_GROWTH))
        most = (end - 1) + (end - 1) * 100 // PERCENT  # words of the class's largest set and its largest match
        out.append((end, most * (100 - PERCENT) // (100 + PERCENT) + 1))
        first = end
    return out


def with_part_hashes(lines: DataFrame) -> DataFrame:
    """lines (with words and n) with parts: hashes of the parts, dealt as for the line's own class of sizes and, if another, for that of its least match.

    Matching sets meet in the class of the smaller one: they differ in fewer words
    than that class has parts. need_own and need_other say how many parts, at the
    least, are equal then; the first count_other of parts are of the other class.
    Sets that match no other have no parts. A part is a range of the words' hashes:
    a run of the sorted hashes and range bounds, from its lower bound on. In a class
    of many parts, a word that falls on a bound opens a part of its own, which leaves
    no fewer parts equal.
    """
    bounds = _classes()
    ends, counts = [end for end, _ in bounds], [parts for _, parts in bounds]
    in_class = lambda size: F.coalesce(*(F.when(size < end, F.lit(k)) for k, end in enumerate(ends)))
    of_class = lambda values, k: F.get(F.array(*(F.lit(x) for x in values)), k)
    n = F.col("n")
    least = F.greatest(_least(n), F.lit(-(-PERCENT // (100 - PERCENT))))
    apart = lambda total: F.floor(total * (100 - PERCENT) / (100 + PERCENT)).cast("int")  # noqa: E731  words that differ, at most, of two sets
    none = F.array().cast("array<long>")
    kinds = ("own", "other")
    wanted = {"own": F.col("can"), "other": F.col("can") & (F.col("own") != F.col("other"))}

    def ranges(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(f"{kind}_count") - 1), lambda p: F.shiftleft(p.cast("long") * F.col(f"{kind}_step") - _HALF, 1))

    def begins(kind: str) -> Column:
        numbers, step = F.col(f"{kind}_numbers"), F.col(f"{kind}_step")
        on_bound = lambda v: (v.bitwiseAND(F.lit(1).cast("long")) == 0) & (F.pmod(F.shiftright(v, 1) + _HALF, step) == 0)
        looked_up = F.transform(ranges(kind), lambda x: F.array_position(numbers, x).cast("int"))
        read_off = F.array_compact(F.transform(numbers, lambda v, i: F.when(on_bound(v), i + 1)))
        return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).when(F.col(f"{kind}_count") <= LOOKED_UP, looked_up).otherwise(read_off)

    def hashes(kind: str) -> Column:
        numbers, begin = F.col(f"{kind}_numbers"), F.col(f"{kind}_begins")
        return F.transform(begin, lambda at, i: F.xxhash64(F.col(kind), F.slice(numbers, at, F.coalesce(F.get(begin, i + 1), F.size(numbers) + 1) - at)))

    # in projections, each of whose columns the next one uses twice: so they aren't merged, and sorting is compiled
    found = lines.select("*", in_class(n).alias("own"), in_class(least).alias("other"), _matches_others(n).alias("can"))
    found = found.select("*", *(of_class(counts, F.col(k)).alias(f"{k}_count") for k in kinds), *(of_class([((1 << 63) - 1) // parts for parts in counts], F.col(k)).alias(f"{k}_step") for k in kinds), of_class(ends, F.col("other")).alias("end"))
    found = found.select("*", *(F.when(wanted[k], F.sort_array(F.concat("words", ranges(k)))).otherwise(none).alias(f"{k}_numbers") for k in kinds))
    found = found.select("*", *(begins(k).alias(f"{k}_begins") for k in kinds))
    return found.select(
        *lines.columns, F.concat(hashes("other"), hashes("own")).alias("parts"), F.size("other_begins").alias("count_other"),
        (F.col("own_count") - apart(n + F.floor(n * 100 / PERCENT))).alias("need_own"), (F.col("other_count") - apart(n + F.col("end") - 1)).alias("need_other"),
    )


def _can_match(a: str, b: str) -> Column:
    """Whether two prefix words that meet allow their lines to be similar enough; a and b prefix the columns' names.

    bits and last describe a window of rarest words, longer than the prefix. The
    line whose window ends first has each of its window's words in the other's
    window or not at all, so bits that the other lacks are words that it lacks.
    """
    n, at, bits, last = (F.col(f"{a}{c}") for c in ("n", "at", "bits", "last"))
    m, there, other_bits, other_last = (F.col(f"{b}{c}") for c in ("n", "at", "bits", "last"))
    need = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    sizes = F.greatest(n, m) * PERCENT <= F.least(n, m) * 100
    missing = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    rest = F.when(last <= other_last, n - missing(bits, other_bits)).otherwise(m - missing(other_bits, bits))
    return sizes & (F.least(n - at, m - there) >= need) & (rest >= need)


def _may_be_in(ids: DataFrame) -> Column:
    """Whether doc may be one of ids (doc): false only if it isn't. The filter is one row of a fixed size."""
    place = F.xxhash64("doc").bitwiseAND(FILTER_BITS - 1)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = ids.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    whole = ids.sparkSession.range(FILTER_BITS >> 6).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    row = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"].cast("string")), ",")).first()[0]
    found = F.get(F.split(F.lit(row), ",").cast("array<long>"), F.shiftright(place, 6).cast("int"))
    return found.bitwiseAND(bit(place)) != 0


def _first_lines(texts: DataFrame) -> DataFrame:
    """The first line of each set: its place and the hashes of its parts."""
    lines = texts.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    # the words as a projection, not from a generator: so that they are told apart and sorted in compiled code
    lines = lines.filter(F.trim("body") != "").select(*_LINE, F.sort_array(word_hashes(F.col("body"))).alias("words"))
    lines = lines.select(*_LINE, "words", F.size("words").alias("n"))
    dealt = ["parts", "count_other", "need_own", "need_other"]
    keyed = with_part_hashes(lines).select(*_LINE, F.xxhash64("words").alias("same"), F.xxhash64(F.lit(1), "words").alias("check"), *dealt)
    rank = F.row_number().over(Window.partitionBy("same", "check").orderBy(*_LINE))
    return keyed.withColumn("rank", rank).filter("rank = 1").select(*_LINE, *dealt)


def _candidates(firsts: DataFrame) -> DataFrame:
    """The places of lines that have enough parts of one class in common with other lines."""
    # a line's hash, its last bits taken by the parts it needs (the limit only lets more pass) and their class
    place = F.xxhash64(*_LINE).bitwiseAND(-1 << 7)
    dealt = firsts.filter(F.size("parts") > 0).select("*", place.alias("place")).select("place", "need_own", "need_other", "count_other", F.posexplode("parts").alias("k", "part"))
    other = F.col("k") < F.col("count_other")
    need = F.least(F.when(other, F.col("need_other")).otherwise(F.col("need_own")), F.lit(63))
    parts = dealt.select(F.col("place").bitwiseOR((need * 2 + other.cast("int")).cast("long")).alias("line"), "part")
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("part")
    enough = F.col("times") >= F.shiftright("line", 1).bitwiseAND(63)
    wanted = parts.join(shared, "part", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("times")).filter(enough)
    wanted = wanted.select(F.col("line").bitwiseAND(-1 << 7).alias("place"))
    return firsts.filter(F.size("parts") > 0).select(*_LINE, place.alias("place")).join(wanted, "place", "left_semi").select(*_LINE)


def _sets(places: DataFrame, texts: DataFrame) -> DataFrame:
    """places with the sets of their lines."""
    wanted = places.groupBy("doc", "version").agg(F.collect_set("line").alias("wanted"))
    lines = texts.filter(_may_be_in(places.select("doc"))).join(wanted, ["doc", "version"])
    lines = lines.select("doc", "version", "wanted", F.posexplode(F.split("text", "\n")).alias("line", "body")).filter(F.array_contains("wanted", F.col("line")))
    return lines.select(*_LINE, word_hashes(F.col("body")).alias("words")).dropDuplicates(_LINE)


def _prefixes(sets: DataFrame, rarity: str) -> DataFrame:
    """What the join looks at of each line: size, prefix, and the bits and end of a window of rarest words."""
    n = F.size("words")
    size = (n - _least(n) + 1).cast("int")
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(w, F.lit(63)).cast("int"))
    lines = sets.select(*_LINE, n.alias("n"), size.alias("size"), by_rarity(F.col("words"), rarity).alias("ordered"))
    window = F.slice("ordered", F.lit(1), F.col("size") + WINDOW)
    bits = F.aggregate(window, F.lit(0).cast("long"), lambda x, w: x.bitwiseOR(bit(w)))
    last = F.get("ordered", F.least(F.col("size") + WINDOW, F.col("n")) - 1)
    return lines.select(*_LINE, "n", F.slice("ordered", F.lit(1), F.col("size")).alias("prefix"), bits.alias("bits"), last.alias("last"))


def _words(prefixes: DataFrame) -> DataFrame:
    """A row for each word of a prefix that isn't unique."""
    return prefixes.select(*_LINE, "n", "bits", "last", F.posexplode("prefix").alias("at", "word")).filter(F.col("word") >= 1 << 56)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct places of pairs (a place and another one) whose sets are similar enough."""
    other = sets.filter(_may_be_in(pairs.select(F.col("other_doc").alias("doc")))).select(*(F.col(c).alias(f"other_{c}") for c in (*_LINE, "words")))
    both = pairs.join(sets.filter(_may_be_in(pairs.select("doc"))), _LINE).join(other, [f"other_{c}" for c in _LINE])
    common = F.size(F.array_intersect("words", "other_words"))
    return both.filter(common * 100 >= (F.size("words") + F.size("other_words") - common) * PERCENT).select(*_LINE).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc, version, line) of the lines that have words and stay; doc is -2^63 for null ids, version the hash of the text."""
    texts = _versions(docs, _spaced(F.col("text")).alias("text")).filter("text is not null")
    firsts = materialize(_first_lines(texts), "line-firsts")
    candidates = materialize(_candidates(firsts), "line-candidates")
    sets = materialize(_sets(candidates, texts), "line-sets")
    prefixes = materialize(_prefixes(sets, rarity_table(sets)), "line-prefixes")
    columns = [*_LINE, "n", "at", "bits", "last"]
    others = [f"other_{c}" for c in _LINE]
    words = _words(prefixes)
    prefixed = lambda row: [F.col(f"{row}.{c}" if row else c).alias(f"other_{c}") for c in columns]
    near = (F.struct(*_LINE) > F.struct(*others)) & _can_match("", "other_")
    earliest = words.groupBy("word").agg(F.min(F.struct(*columns)).alias("first")).select("word", *prefixed("first"))
    stars = materialize(words.join(earliest, "word").filter(near).select(*_LINE, *others).distinct(), "line-stars")
    settled = materialize(_verified(stars, sets), "line-settled")
    left = _words(prefixes.join(settled, _LINE, "left_anti"))
    pairs = left.join(words.select("word", *prefixed("")), "word").filter(near).select(*_LINE, *others).distinct()
    pairs = materialize(pairs.join(stars, [*_LINE, *others], "left_anti"), "line-pairs")
    similar = materialize(settled.unionByName(_verified(pairs, sets)), "line-similar")
    for used in (candidates, sets, prefixes, stars, settled, pairs):
        discard(used)
    return firsts.select(*_LINE).join(similar, _LINE, "left_anti")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id and kept_lines (numbers from 0 of the lines that have words and stay), for every distinct doc_id and text."""
    kept = kept_lines(docs).groupBy("doc", "version").agg(F.sort_array(F.collect_list("line")).alias("kept_lines"))
    found = _versions(docs).distinct().join(kept, ["doc", "version"], "left")
    return found.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), F.coalesce("kept_lines", F.array().cast("array<int>")).alias("kept_lines"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs with the text of the lines that stay; rows that had words and have none left go."""
    kept = kept_lines(docs).groupBy("doc", "version").agg(F.collect_list("line").alias("kept"))
    keyed = _versions(docs, whole_row(docs).alias("row")).join(kept, ["doc", "version"], "left")
    worded = lambda c: F.coalesce(c, F.lit("")).rlike("[^ \\t-\\r]")
    stays = F.filter(F.split("row.text", "\n"), lambda x, i: F.coalesce(F.array_contains("kept", i), F.lit(False)) | ~worded(x))
    # from a generator, so that the lines are judged once
    whole = keyed.select("row", F.explode(F.array(F.array_join(stays, "\n"))).alias("text"))
    return whole.filter(worded(F.col("text")) | ~worded(F.col("row.text"))).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
