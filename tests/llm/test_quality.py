from __future__ import annotations

import random
from collections import Counter

from quernstone.llm import quality

from . import helpers


def plain(text):
    """The report's figures by direct counting."""
    w = helpers.split(text)
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    out = {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines))}

    def covered(n, first):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        counts, seen, inside = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if counts[g] > 1 and (first or g in seen):
                inside.update(range(i, i + n))
            seen.add(g)
        return inside

    out["n_repeat_words"] = len(covered(3, True))
    for n in quality.NGRAM_LIMITS:
        out[f"dup{n}_chars"] = sum(len(w[i].decode()) for i in covered(n, False))
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    return out


def random_texts():
    random.seed(5)
    return [" ".join(random.choice(["a", "bb", "çc", "#d", "e|"]) + random.choice(["", "\n", "1"]) for _ in range(random.randint(0, 90))) for _ in range(120)]


def test_figures_match_direct_counting():
    texts = random_texts()
    stats = quality.repetition_stats([t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = plain(t)
        assert {k: int(stats[k][i]) for k in want} == {k: int(v) for k, v in want.items()}


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    report = quality.repetition_report(docs).collect()
    assert len(report) == docs.count()
    by = {r.doc_id: r for r in report}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[7].n_words == 20_000 and not by[7].kept
    assert by[0].kept and by[8].n_dup_lines == 3 and not by[8].kept
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in report if r.kept and r.doc_id is not None)


def test_no_rows(spark):
    assert quality.repetition_report(helpers.empty(spark)).count() == 0
    assert quality.keep_documents(helpers.empty(spark)).count() == 0


def test_good_texts_stay(spark, sf):
    report = quality.repetition_report(spark.read.parquet(f"{sf}/documents.parquet")).filter("not base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = report.join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("kept").count() >= 0.98 * good.count()
    bad = report.join(labels.filter("quality = 0"), "doc_id")
    assert bad.filter("not kept").count() >= 0.8 * bad.count()
