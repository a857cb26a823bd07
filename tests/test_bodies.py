"""Page bodies against a plain cut, ragged grids and tables in every encoding, exports of one conversation."""

from __future__ import annotations

import html as markup
import re

import duckdb
import pytest

from quernstone.operators import corpus
from quernstone.operators import text as ot
from quernstone.plans import catalog_text
from quernstone.sources import bodies, files

PAGE = """<html><head><title> T
 1</title><meta name="Author" content="A"><meta property="og:title" content="Real  title"></head><body><p>before</p>
<div id="js_content"><h1>Head</h1>one <b>two<i>three</b><img data-src="a.png" data-w="640" data-ratio="0.5"><noscript>no<img src="n.png"></noscript>
<section/><div>in<br/>ner</div><script>if (a < b) "</div>"</script><img src="b.png" alt="x"/></div><p>after</p></body></html>"""


def test_container_with_images_and_metadata():
    body, n, status, title, authors, author_status, images = bodies.page_body(PAGE, element_id="js_content")
    assert body.split("\n") == ["Head", "one twothree", "in", "ner"] and (n, status) == (1, "confirmed")
    assert (title, authors, author_status) == ("Real title", ["A"], "single_confirmed")
    assert [(i["position"], i["chars_before"], i["reference"], i["width"], i["height_ratio"], i["alt"]) for i in images] == [(1, 15, "a.png", "640", "0.5", None), (2, 20, "b.png", None, None, "x")]


def test_profiles():
    assert bodies.page_body("<p>x</p>", tag="article")[:3] == ("x", 0, "whole_page")
    assert bodies.page_body("<p>x</p>", tag="article", profile="article")[:3] == ("", 0, "missing")
    assert "before" in bodies.page_body(PAGE, element_id="js_content", profile="generic")[0]
    twice = "<article>a<article>b</article></article><article>c</article><meta name=author content=A><meta name=author content=B>"
    assert bodies.page_body(twice, tag="article")[:6] == ("a\nb\nc", 2, "several", "", ["A", "B"], "conflicting")
    assert bodies.page_body("", tag="article")[:3] == ("", 0, "whole_page")
    for wrong in ({}, {"tag": "article", "profile": "x"}):
        with pytest.raises(ValueError):
            bodies.page_body("", **wrong)


def test_pages_equal_a_plain_cut(spark, sf):
    got = {r.page_id: r for r in catalog_text.page_bodies(spark, sf).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(pages) > 0
    for page_id, page in pages:
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        inner = re.sub(r"<(script|style|svg|noscript|template)\b.*?</\1>|<!--.*?-->", "", inner, flags=re.S)
        want = markup.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", inner))
        assert "".join(got[page_id].body.split()) == "".join(want.split()) and got[page_id].status == "confirmed"
        assert got[page_id].title == re.sub(r"\s+", " ", markup.unescape(re.search(r"<title>(.*?)</title>", page, re.S).group(1))).strip()


def test_null_pages(spark):
    rows = {r.k: r for r in bodies.page_bodies(spark.createDataFrame([(1, None), (2, "<article>a<img src=i></article>")], "k int, html string"), "k", tag="article").collect()}
    assert rows[1].body is None and rows[1].images is None and rows[2].body == "a" and rows[2].images[0].reference == "i"
    assert bodies.page_bodies(spark.createDataFrame([], "k int, html string"), "k", tag="article").count() == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030", "utf-16"])
def test_delimited_in_any_encoding(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes('名称;值\n中文,字;1\n"两\n行";\n'.encode(encoding))
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["名称", "值"] and {tuple(r) for r in df.collect()} == {("中文,字", "1"), ("两\n行", None)}


def test_files_of_different_encodings(spark, tmp_path):
    for i, encoding in enumerate(["utf-8", "gb18030", "utf-16"]):
        (tmp_path / f"{i}.csv").write_bytes(f"名,n\n字,{i}\n".encode(encoding))
    assert {tuple(r) for r in files.read_delimited(spark, str(tmp_path)).collect()} == {("字", str(i)) for i in range(3)}
    (tmp_path / "z.csv").write_bytes(b"other,n\n1,2\n")
    with pytest.raises(files.SourceError, match="differ"):
        files.read_delimited(spark, str(tmp_path))


def test_given_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a,b\n1,2\n".encode())
    assert files.read_delimited(spark, str(tmp_path / "a.csv"), "utf-8").first() == ("1", "2")
    (tmp_path / "g.csv").write_bytes("名,b\n1,2\n".encode("gb18030"))
    assert files.read_delimited(spark, str(tmp_path / "g.csv"), "gb18030").columns == ["名", "b"]


def test_ragged_grids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "GRID_BATCH", 2)
    (tmp_path / "a.tsv").write_bytes("x\ty\t\t\n\n1\t\t3\n\t\t\n\n".encode("utf-16"))
    (tmp_path / "b.csv").write_bytes("甲,乙,丙\n一,二,三,四\n".encode("gb18030"))
    (tmp_path / "empty.csv").write_bytes(b"\n,,\n")
    (tmp_path / "bad.txt").write_bytes(b"a,b\xff\n1,2\n")  # no encoding fits an odd number of such bytes
    got = {(r.path.rsplit("/", 1)[1], r.row_no): (r.encoding, r.cells) for r in files.read_grids(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.tsv", 0): ("utf-16", ["x", "y"]), ("a.tsv", 1): ("utf-16", []), ("a.tsv", 2): ("utf-16", ["1", "", "3"]), ("b.csv", 0): ("gb18030", ["甲", "乙", "丙"]), ("b.csv", 1): ("gb18030", ["一", "二", "三", "四"]),
        ("empty.csv", None): ("utf-8-sig", None), ("bad.txt", 0): ("utf-8-replace", ["a", "b\ufffd"]), ("bad.txt", 1): ("utf-8-replace", ["1", "2"]),
    }
    assert {r.row_no for r in files.read_grids(spark, str(tmp_path), most_rows=1).collect() if r.path.endswith("b.csv")} == {0}


def test_canonical_export_by_every_tie(spark):
    rows = [("c", "p1", "m1", 1), ("c", "p1", "m1", 1), ("c", "p2", "m1", 1), ("c", "p2", "m2", 1), ("c", "p3", "m1", 1), ("c", "p3", "m2", 1), ("c", "p3", "m2", 1), ("d", "q1", "m", 1), ("d", "q2", "m", 5), ("e", "r1", "m", 2), ("e", "r2", "m", 2), ("e", "r2", None, None), (None, "s", None, None)]
    got = {(r.conv, r.path): (r.unique_messages, r.messages, r.rank, r.canonical_path, r.status) for r in ot.rank_exports(spark.createDataFrame(rows, "conv string, path string, m string, b int"), "conv", "path", "m", ot.F.col("b")).collect()}
    assert got["c", "p3"] == (2, 3, 1, "p3", "canonical") and got["c", "p2"] == (2, 2, 2, "p3", "variant") and got["c", "p1"][2] == 3
    assert got["d", "q2"][4] == "canonical" and got["e", "r2"][4] == "canonical" and got[None, "s"][4] == "canonical"


def segment(marker, body=b""):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def test_image_headers(spark):
    frame = b"\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\x01" + b"\0" * 3
    start = b"\xff\xd8"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR"
    data = {
        "first": (start + segment(0xC0, frame), 30, 20), "later": (start + segment(0xE0, b"JFIF") + segment(0xC4, b"x" * 40) + b"\xff\xff\x01" + segment(0xC2, frame), 30, 20), "pixels": (start + segment(0xDA, b"x" * 9) + segment(0xC0, frame), None, None),
        "cut": (start + segment(0xE0, b"x" * 50)[:20], None, None), "bare": (start, None, None), "png": (png + (7).to_bytes(4, "big") * 2, 7, 7), "short": (png + b"\0\0", None, None), "none": (None, None, None), "text": (b"hello", None, None),
        "looped": (start + b"\xff\xe0\0\0" + b"\0" * 20, None, None),
    }
    rows = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in data.items()], "path string, content binary")
    got = {r.path: r for r in files.image_profiles(rows).collect()}
    assert {k: (got[k].width, got[k].height) for k in data} == {k: v[1:] for k, v in data.items()}
    assert (got["first"].aspect_ratio, got["first"].orientation, got["first"].pixel_status) == (1.5, "landscape", "readable") and got["png"].orientation == "square"
    assert got["text"].pixel_status == "unreadable" and got["text"].orientation is None


def test_canonical_counts(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("", True), (None, True)], "role string, canonical boolean")
    assert {tuple(r) for r in corpus.canonical_counts(rows, ot.F.col("role"), "file").collect()} == {("a", 2), ("file", 2)}
