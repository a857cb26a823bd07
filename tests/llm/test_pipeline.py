"""The pipeline's stages, each held against what its operator says of its own input."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quernstone.llm import quality, queries, shingles  # noqa: E402
from quernstone.llm.common import materialize  # noqa: E402

from . import helpers  # noqa: E402
from .test_linededup import stripped  # noqa: E402
from .test_shingles import brute as brute_components  # noqa: E402


def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages(spark, sf):
    docs = small(spark, sf)
    columns = docs.columns
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(materialize(stage(spark, after[-1], sf), "test-" + name.replace(" ", "-")))
    for df in after[1:-1]:
        assert df.columns == columns
    kept = {r.doc_id for r in quality.repetition_report(docs).filter("kept").collect()}
    assert {r.doc_id for r in after[1].collect()} == kept
    assert sorted(helpers.texts_of(after[2]), key=str) == stripped(helpers.texts_of(after[1]))
    components = brute_components(helpers.texts_of(after[2]))
    assert {r.doc_id for r in after[3].collect()} == {k for k, _, c in components if k == c}
    mixed = sorted(r.doc_id for r in after[4].collect())
    assert mixed == sorted(r.doc_id for r in queries.mix_documents(after[3]).select("row.doc_id").collect()) and mixed
    packed = after[5].collect()
    assert {r.doc_id for r in packed} == set(mixed) and sum(r.piece == 0 for r in packed) == len(mixed)


def test_stages_take_awkward_rows(spark, sf):
    docs = helpers.awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, helpers.empty(spark), sf).count() == 0
    assert shingles.keep_representatives(docs).count() < docs.count()


def test_stages_take_dotted_names_and_unnamed_copies(spark, sf):
    docs = helpers.awkward(spark).withColumnRenamed("n", "a.b").withColumnRenamed("kept", "c`d.e")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0, name
    line = helpers.words(40, 3000)
    rows = [(None, line, "en", "src0")] * 3 + [(None, line + " more", "en", "src0"), (None, helpers.words(40, 4000), "en", "src0"), (7, helpers.words(40, 4000), "en", "src0"), (None, None, "en", "src0"), (None, None, "en", "src0")]
    left = shingles.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left) == [(0, ""), (0, ""), (0, "w3000"), (7, "w4000")]


def test_all_stages_on_awkward_rows(spark, sf):
    docs = helpers.awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "awkward-" + name.replace(" ", "-"))
    assert "sequence_id" in docs.columns


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
