import json
import struct

import pytest
from pyspark.sql import functions as F

from quirebase.functions.columns import Strategies, enriched, without_private
from quirebase.sources import files


def test_collections(spark, tmp_path):
    (tmp_path / "in" / "below").mkdir(parents=True)
    for name in ("a.pdf", "B.PDF", "c.txt", "below/d.pdf"):
        (tmp_path / "in" / name).write_bytes(b"%PDF" + name.encode())
    (tmp_path / "own.pdf").write_bytes(b"x")
    out = files.pdfs(spark, [str(tmp_path / "in"), str(tmp_path / "own.pdf")]).collect()
    assert sorted(r.path.rsplit("/")[-1] for r in out) == ["B.PDF", "a.pdf", "own.pdf"]
    old = spark.createDataFrame([("d", "c.txt", 1, b"1"), ("e", "c.txt", 1, b"2")], "doc string, name string, length long, content binary")
    put = files.with_images(old, spark, "d", str(tmp_path / "in")).collect()
    assert sorted((r.doc, r.name, bytes(r.content)) for r in put) == [("d", "B.PDF", b"%PDFB.PDF"), ("d", "a.pdf", b"%PDFa.pdf"), ("d", "c.txt", b"%PDFc.txt"), ("e", "c.txt", b"2")]


def test_json_store_and_migration(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "1", "n": 2}, {"id": "2", "n": None}]))
    bad.write_text('[{"id": "1", ')
    rows = files.json_records(spark, str(good), "id string, n int")
    assert sorted(map(tuple, rows.collect())) == [("1", 2), ("2", None)]
    empty = files.json_records(spark, str(bad), "id string, n int")
    assert empty.count() == 0
    tables = {"records": rows, "notes": empty}
    dry = files.migrated(spark, tables, str(tmp_path / "out"), dry=True).collect()
    assert not (tmp_path / "out").exists()
    assert sorted(dry) == sorted(files.migrated(spark, tables, str(tmp_path / "out")).collect()) and dict(dry) == {"records": 2, "notes": 0}


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, "<x>", 1.0)], "id int, name string, conf double")
    for form in ("csv", "json", "xml"):
        files.exported(df, str(tmp_path / form), form)
        back = spark.read.schema(df.schema).option("header", True).option("rowTag", "row").format(form).load(str(tmp_path / form))
        assert sorted(map(tuple, back.collect())) == [(1, "a,b", 0.5), (2, "<x>", 1.0)], form


def test_strategies_and_enrichment(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page int, _slot string")
    assert without_private(pages).columns == ["page"]
    out = enriched(pages, lambda p: p.where("page = 1").select("page", F.lit(3).alias("boxes")), "page")
    assert sorted(map(str, out.collect())) == ["Row(page=1, boxes=3, warning=None)", "Row(page=2, boxes=None, warning='not enriched')"]
    s = Strategies("local")
    s.add("local", lambda d: d.where("page = 1"))
    s.add("both", lambda d: d, without_private)
    assert s.run(None, pages).count() == s.run("odd", pages).count() == 1 and s.run(" Both ", pages).columns == ["page"]


def jpeg(width, height, orientation=None):
    exif = b"Exif\0\0MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 9, 0) + struct.pack(">HHIHH", 274, 3, 1, orientation, 0) if orientation else b""
    app1 = b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif if exif else b""
    return b"\xff\xd8" + app1 + b"\xff\xc4\x00\x04ab\xff" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 4


def test_labelled_images(spark, tmp_path):
    images, labels = tmp_path / "images" / "val", tmp_path / "labels" / "val"
    images.mkdir(parents=True)
    labels.mkdir(parents=True)
    made = {"a.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480), "b.jpg": jpeg(30, 20), "c.jpeg": jpeg(30, 20, 6), "d.jpg": jpeg(30, 20, 3), "e.gif": b"GIF89a" + struct.pack("<HH", 7, 9), "f.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), "g.jpg": b"\xff\xd8\xff", "h.dat": b"?"}
    for name, content in made.items():
        (images / name).write_bytes(content)
    (labels / "a.txt").write_text("0 0.5 0.25\n\n  3\t1 2 \n")
    (labels / "b.txt").write_text("\n")
    got = {r.path.rsplit("/")[-1]: (r.width, r.height, r.label) for r in files.labelled(spark, str(tmp_path), "val").collect()}
    assert got["a.png"] == (640, 480, [[0.0, 0.5, 0.25], [3.0, 1.0, 2.0]]) and got["b.jpg"] == (30, 20, [])
    assert {n: got[n][:2] for n in made if n > "c"} == {"c.jpeg": (20, 30), "d.jpg": (30, 20), "e.gif": (7, 9), "f.bmp": (5, 6), "g.jpg": (None, None), "h.dat": (None, None)}
    assert all(got[n][2] is None for n in made if n > "c")
    with pytest.raises(ValueError):
        files.labelled(spark, str(tmp_path), "test")
