"""Small awkward inputs shared by the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, kept string, row string, doc long, epoch int, shard int, held_out string, score string"


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


def awkward(spark):
    """Nulls in every column, empty and blank and long texts, repeated rows, ties, and extra columns of clashing names."""
    extra = (8, 9, "k", "r", 9, 1, 2, "h", "s")
    line = words(60)
    rows = [
        (0, line, "en", "src0"), (50, line, "en", "src1"), (50, line, "en", "src1"), (2, None, None, None), (3, "", "de", "src2"), (4, " \t\n ", "de", "nowhere"), (None, words(70, 500), "xx", None),
        (None, None, None, None), (5, words(3), "en", "src0"), (6, words(60).upper(), "en", "src0"), (7, "lang " * 20_000, "en", "src3"), (8, "\n".join([words(20, 900)] * 4 + [words(20, 950)]), "fr", "src4"),
        (9, line + " extra", "en", "src0"), (10, "é à  ü 中文 \x00 x" * 30, "fr", "src5"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def split(text):
    return text.encode().split() if text else []


def lower_split(text):
    return text.encode().lower().split() if text else []
