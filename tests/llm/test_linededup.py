from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import linededup

from . import helpers


def version(text):
    """Spark's xxhash64 of a text, which orders the texts of one id."""
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64)


def words_of(line):
    return set(line.encode().split())


def brute(docs):
    """(id, text) to the numbers of its kept lines with words, by comparing every line with all earlier ones."""
    seen, kept = [], {}
    for k, text in sorted({x for x in docs if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, version(x[1]))):
        kept[k, text] = []
        for i, line in enumerate(text.split("\n")):
            s = words_of(line)
            if s and not any(100 * len(s & o) >= linededup.PERCENT * len(s | o) for o in seen):
                kept[k, text].append(i)
            if s:
                seen.append(s)
    return kept


def expected(docs):
    """What line_report() returns, sorted."""
    kept = brute(docs)
    return sorted(((k, kept.get((k, t), [])) for k, t in set(docs)), key=str)


def stripped(docs):
    """What remove_lines() leaves of the rows, sorted."""
    kept = brute(docs)
    out = []
    for k, t in docs:
        left = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i in kept[k, t] or not words_of(x))
        if not (t and words_of(t)) or words_of(left):
            out.append((k, left))
    return sorted(out, key=str)


def report(df):
    return sorted(((r.doc_id, list(r.kept_lines)) for r in linededup.line_report(df).collect()), key=str)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    rows = helpers.texts_of(docs)
    assert report(docs) == expected(rows)
    out = linededup.remove_lines(docs)
    assert out.columns == docs.columns
    assert sorted(helpers.texts_of(out), key=str) == stripped(rows)
    texts = defaultdict(list)
    for k, t in helpers.texts_of(out):
        texts[k].append(t)
    assert texts[0] == [helpers.words(60)] and 9 not in texts and 50 not in texts
    assert texts[2] == [None] and texts[3] == [""] and texts[5] == [helpers.words(3)]
    assert texts[8] == [helpers.words(20, 900) + "\n" + helpers.words(20, 950)]


def test_rows_that_share_an_id_are_told_apart(spark):
    common = helpers.words(40)
    docs = [(1, common)] + [(k, f"{a}\n{b}") for k in (7, None) for a, b in ((helpers.words(3, 700), common + " x"), (common + " y", f"only here {k}"), (common + " z", f"nor there {k}"))]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    assert report(df) == expected(docs)
    assert sorted(helpers.texts_of(linededup.remove_lines(df)), key=str) == stripped(docs + docs[:3])
    left = [t for _, t in helpers.texts_of(linededup.remove_lines(df))]
    assert all(any(f"{what} {k}" in t for t in left) for what in ("only here", "nor there") for k in (7, None))


def test_white_space_of_every_kind_parts_words(spark):
    docs = [(1, "a\tb\x0bc\x0cd\re f g h i j"), (2, "j i h g f e d c b a\n\x0b\x0c\nk"), (3, "\x0b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert report(df) == expected(docs) == [(1, [0]), (2, [2]), (3, [])]
    assert sorted(helpers.texts_of(linededup.remove_lines(df))) == [docs[0], (2, "\x0b\x0c\nk"), docs[2]]


def test_variants_against_brute_force(spark):
    random.seed(8)
    base = [f"b{i}" for i in range(30)]
    docs = []
    for k in range(150):
        lines = []
        for _ in range(3):
            line = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3])):
                line[random.randrange(30)] = f"x{random.randrange(40)}"
            lines.append(" ".join(line[: random.choice([30, 30, 29, 12])]))
        lines.append(" ".join(random.choices([f"r{i}" for i in range(300)], k=random.randint(1, 25))))
        docs.append((k, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert report(df) == expected(docs)
    assert sorted(helpers.texts_of(linededup.remove_lines(df)), key=str) == stripped(docs)


def test_matching_sets_have_a_part_in_common(spark):
    """Every size of the first classes, and a large one, with as many words changed as the threshold allows."""
    random.seed(4)
    rows = []
    for n in [*range(9, 60), 200, 2000]:
        for m in {n, n * 100 // linededup.PERCENT}:
            shared = -(-(n + m) * linededup.PERCENT // (100 + linededup.PERCENT))
            a = [random.randrange(-1 << 63, 1 << 63) for _ in range(n)]
            a[:2] = [-1 << 63, 0]  # on bounds of parts
            rows.append((n, m, a, a[:shared] + [random.randrange(-1 << 63, 1 << 63) for _ in range(m - shared)]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, size int, larger int, a array<long>, b array<long>")
    found = {c: {r.i: r for r in linededup.with_part_hashes(df.select("i", F.col(c).alias("words"), F.size(c).alias("n"))).collect()} for c in "ab"}
    for i in range(len(rows)):
        a, b = found["a"][i], found["b"][i]
        assert len(a.parts) <= 0.35 * a.n + 6
        own, other = a.parts[a.count_other :], b.parts[: b.count_other]
        meet = len(set(own) & set(b.parts[b.count_other :]))
        if b.count_other and set(own) & set(other):
            assert len(set(own) & set(other)) >= max(a.need_own, b.need_other) >= 1
        else:
            assert meet >= max(a.need_own, b.need_own) >= 1


def test_short_lines_take_part(spark):
    nine = helpers.words(9, 100)
    docs = [
        (1, "Read more\n\nThe The The The The The\na b c d"),
        (2, "more  Read\n\nThe\na b c e\n" + nine),
        (3, "Read more"),
        (4, " \n" + nine + " w109\na b c d\nnew"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert report(df) == expected(docs) == [(1, [0, 2, 3]), (2, [3, 4]), (3, []), (4, [3])]
    assert dict(helpers.texts_of(linededup.remove_lines(df))) == {1: docs[0][1], 2: "\na b c e\n" + nine, 4: " \nnew"}


def test_plan_has_no_python(spark):
    plan = linededup.line_report(helpers.awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_rows(spark):
    assert linededup.line_report(helpers.empty(spark)).count() == 0
    assert linededup.remove_lines(helpers.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert linededup.line_report(nothing).filter(F.size("kept_lines") == 0).count() == 2
