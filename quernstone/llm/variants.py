"""Spelling variants: words at one edit from each other, by forward and backward automata.

A word's form is the most frequent word near it (ties: the first in code-point order)
that occurs at least RATIO times as often; near means exactly one code point inserted,
deleted or replaced. Its root is where following forms ends.

1. Words are counted, first within Arrow batches and then over the corpus.
2. One edit leaves the first half of a word as it is, or else the rest of it. So a word
   can only be near another one that begins with its first half, or ends with the
   rest, and such words meet in one task: each word is entered under the halves that
   words of its own length, one less and one more have, and asks under its own.
3. A task enters its words in a minimal acyclic automaton, backward ones reversed,
   whose states know how many words lie below: so a path's place among the sorted words
   is a perfect hash. A query walks its exact half, then completes the word with one
   error. What forward search finds is left out of backward search by looking at the
   first half, so nothing counts twice.
4. Each query returns how many words it is near and the most frequent one; both are
   put together by word. Roots are found by doubling the steps.

Tasks hold SHARD_WORDS words, about: halves are dealt by hash, and a half with more
words than that is dealt to several automata, all of which its words ask.

Defined cases: null texts have no words; a null id counts as the empty text in the
damage rule; texts repeated whole count again; words of equal count take the first in
code-point order; extra columns are ignored; no words give no rows. A long text is
read in one step, in memory of a few times its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize

#: Words of one automaton, about.
SHARD_WORDS = 1 << 15
#: Words that a task counts before it passes the counts on.
COUNTED = 1 << 17
#: Most frequent halves up to which their list is broadcast.
HOT_LIMIT = 10_000
RATIO = 5
LEAST_LENGTH = 6
LEAST_COUNT = 5


def _counted(least: int, damage: int | None):
    """Partial counts of the words of at least least code points, as (word, n)."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in byte_slices(batches):
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                own = Counter(runs.findall(text.encode().lower().decode()))
                if damage:
                    first = zlib.crc32(f"{doc}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), first) % damage == 0]:
                        at = zlib.crc32(word.encode(), first) % len(word)
                        if len(word) > least:
                            counts[word[:at] + word[at + 1 :]] += own[word]
                        del own[word]
                counts.update(own)
            if len(counts) >= COUNTED:
                yield _pairs(counts)
                counts = Counter()
        if counts:
            yield _pairs(counts)

    return count


def _pairs(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, damage: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the runs of Latin letters in docs (doc_id, text), A-Z lower-cased.

    With damage, a run of which ``crc32("<doc_id>:<run>")`` is a multiple of damage loses
    the code point at that number modulo its length: known misspellings, for tests.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    partial = rows.mapInArrow(_counted(least_length, damage), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; words are known by their place among them."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.below: list[int] = []  # words that end at a state or below it
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # states of the last word that may still grow
        last = ""
        for word in words:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            self._settle(path, last, shared)
            path += [({}, False) for _ in range(shared, len(word))]
            path[len(word)] = (path[len(word)][0], True)
            last = word
        self._settle(path, last, 0)
        self.root = self._state(*path[0])

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())  # words come sorted, so arcs do
        if key not in self._known:
            self._known[key] = len(self.next)
            self.next.append(arcs)
            self.final.append(final)
            self.below.append(final + sum(self.below[t] for t in arcs.values()))
        return self._known[key]

    def _settle(self, path: list, word: str, keep: int) -> None:
        while len(path) - 1 > keep:
            state = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def step(self, state: int, number: int, letter: str) -> tuple[int, int] | None:
        """The state behind letter, and number raised by the words that are skipped."""
        if letter not in self.next[state]:
            return None
        number += self.final[state]
        for arc, target in self.next[state].items():
            if arc == letter:
                return target, number
            number += self.below[target]
        return None

    def walk(self, word: str, state: int, number: int) -> tuple[int, int] | None:
        for letter in word:
            found = self.step(state, number, letter)
            if found is None:
                return None
            state, number = found
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first exact letters of word and differ from it by one error after them."""
        at = self.walk(word[:exact], self.root, 0)
        found: set[int] = set()

        def end(rest: str, state: int, number: int) -> None:
            last = self.walk(rest, state, number)
            if last and self.final[last[0]]:
                found.add(last[1])

        for k in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            if k < len(word):
                end(word[k + 1 :], state, number)  # word[k] too much
            for letter in self.next[state]:
                target = self.step(state, number, letter)
                end(word[k:], *target)  # letter missing before word[k]
                if k < len(word) and letter != word[k]:
                    end(word[k + 1 :], *target)  # letter instead of word[k]
            at = self.step(state, number, word[k]) if k < len(word) else None
        return found


def _half(n: int) -> int:
    return n // 2


def _asked(part: pa.Table) -> pa.Table:
    """Near words of a shard's queries: word, n, how many, the best one's count and itself."""
    backward = part.column("backward")[0].as_py()
    words, counts, asks = (part.column(c).to_pylist() for c in ("word", "n", "asks"))
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    entered = dict(zip(map(turn, words), counts, strict=True))
    for word, enters in zip(words, part.column("enters").to_pylist(), strict=True):
        if not enters:
            entered.pop(turn(word), None)
    entered_words = sorted(entered)
    automaton = Automaton(entered_words)
    out = []
    for word, n, asking in zip(words, counts, asks, strict=True):
        if asking:
            half = _half(len(word))
            near = [entered_words[k] for k in automaton.near(turn(word), len(word) - half if backward else half)]
            if backward:
                near = [turn(v) for v in near if turn(v)[:half] != word[:half]]  # those were found forward
            if near:
                best = min(near, key=lambda v: (-entered[turn(v)], v))
                out.append((word, len(near), entered[turn(best)], best))
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table({k: pa.array(c, kind) for (k, kind), c in zip(kinds.items(), columns, strict=True)})


def near_words(words: DataFrame, n_words: int) -> DataFrame:
    """word, n_near and the best near word (best_n, best) of the words (word, n) that are near others."""
    length = F.char_length("word")
    halves = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda n: F.floor(n / 2)))
    entries = []
    for backward in (False, True):
        # a word of n letters asks with its first n // 2 letters forward and with its last n - n // 2 backward
        if backward:
            kept = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda n: n - F.floor(n / 2)))
            own, cut = length - F.floor(length / 2), lambda size: F.substr(F.col("word"), F.char_length("word") - size + 1, size)
        else:
            kept, own, cut = halves, F.floor(length / 2), lambda size: F.substr(F.col("word"), F.lit(1), size)
        sized = words.select("word", "n", own.alias("own"), F.explode(kept).alias("size")).filter(F.col("size") > 0)
        entries.append(sized.select("word", "n", F.lit(backward).alias("backward"), F.concat(F.col("size").cast("string"), F.lit(":"), cut(F.col("size").cast("int"))).alias("half"), (F.col("size") == F.col("own")).alias("asks")))
    entered = entries[0].unionByName(entries[1])
    shards = max(1, -(-4 * n_words // SHARD_WORDS))
    hot = entered.groupBy("backward", "half").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > SHARD_WORDS)
    hot = materialize(hot.select("backward", "half", F.ceil(F.col("times") / SHARD_WORDS).cast("int").alias("parts")), "hot-halves")
    side = F.broadcast(hot) if hot.count() <= HOT_LIMIT else hot
    dealt = entered.join(side, ["backward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    sent = dealt.withColumn("home", home).withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))))
    sent = sent.select("backward", F.when(F.col("parts") > 1, F.xxhash64("half", "part")).otherwise(F.pmod(F.xxhash64("half"), F.lit(shards))).alias("shard"), "word", "n", "asks", (F.col("part") == F.col("home")).alias("enters"))
    # a word can be in a shard by several halves
    once = sent.groupBy("backward", "shard", "word", "n").agg(F.bool_or("asks").alias("asks"), F.bool_or("enters").alias("enters"))
    found = once.groupBy("backward", "shard").applyInArrow(_asked, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): both ends of every chain, found by doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.filter("moved").isEmpty()
        discard(now)
        now = step.select("word", "root")
        now._scratch_path = step._scratch_path
        if not moved:
            return now


def group_variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of words (word, n; words distinct)."""
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, words.count())
    good = F.col("best_n") >= RATIO * F.col("n")
    linked = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "word-forms")
    roots = _roots(linked.filter("form IS NOT NULL"))
    discard(words)
    return linked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
