import datetime as dt
import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from tarnbeck.sources import files
from tarnbeck.streaming import events


def test_json_adapter(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"items": [{"id": "1", "x": 2}, {"id": "2", "y": None}], "other": 1}), encoding="utf-8")
    (tmp_path / "b.json").write_text("not json", encoding="utf-8")
    raw = files.read_json_text(spark, str(tmp_path))

    @files.adapter("catalog")
    def catalog(df):
        return files.array_records(df, "/items", "entry", "id", ["id", "x"])

    out = {r["pointer"]: r for r in files.ADAPTERS["catalog"](raw).collect()}
    assert set(out) == {"/items/0", "/items/1"} and out["/items/1"]["unknown_fields"] == ["y"] and out["/items/0"]["key"] == "1"
    assert json.loads(out["/items/0"]["raw"]) == {"id": "1", "x": 2}


def test_null_characters(spark):
    df = spark.createDataFrame([("a\x00b",), ('{"a":"\\u0000"}',), ('{"a":"\\\\u0000"}',), ("ok",)], "raw string")
    assert [r[0] for r in df.select(files.has_null_character("raw")).collect()] == [True, True, False, False]


def test_files_and_inventory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"%PDF-1.4 a")
    (tmp_path / "x" / "b.bin").write_bytes(b"zzz")
    found = files.read_files(spark, str(tmp_path / "x"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    sha = hashlib.sha256(b"%PDF-1.4 a").hexdigest()
    assert got["a.pdf"]["asset_id"] == sha and got["a.pdf"]["media_type"] == "application/pdf" and got["a.pdf"]["storage_key"] == f"objects/{sha[:2]}/{sha}"
    base = got["a.pdf"]["path"].rsplit("/", 1)[0]
    reg = spark.createDataFrame([(f"{base}/a.pdf", sha), (f"{base}/b.bin", "old"), (f"{base}/c", "gone")], "path string, asset_id string")
    old = spark.createDataFrame([(f"{base}/a.pdf", sha), (f"{base}/d", "was")], "path string, asset_id string")
    out = {r["path"].rsplit("/", 1)[1]: (r["status"], r["change"]) for r in files.inventory(found, reg, old).collect()}
    assert out == {"a.pdf": ("registered", "same"), "b.bin": ("changed", "added"), "c": ("missing", None), "d": (None, "removed")}


def test_word(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    wide = '<w:gridSpan w:val="2"/>'
    body = f'<w:p><w:r><w:t>标</w:t></w:r><w:r><w:t>题</w:t></w:r></w:p><w:tbl><w:tr>{cell("a", wide)}{cell("b")}</w:tr></w:tbl>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no")
    out = files.read_word(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
    assert [(r["kind"], r["text"], r["row_index"], r["column"]) for r in out] == [("paragraph", "标题", None, None), ("cell", "a", 0, 0), ("cell", "b", 0, 2), ("unreadable", None, None, None)]


def test_append_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, v int")
    files.append_absent(df, path, ["k"])
    files.append_absent(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_report_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    first = files.write_report(df, str(tmp_path), "kind")
    assert files.write_report(df.orderBy(F.desc("v")), str(tmp_path), "kind") == first
    assert files.write_report(df.limit(1), str(tmp_path), "kind") != first
    assert spark.read.json(first).count() == 2
    ids = [r["registration_id"] for r in files.register(df, "n", "k").collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)


def test_stream(spark, tmp_path):
    at = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
    schema = "id string, key string, at timestamp, value string"
    rows = [("1", "k", at(0), "a"), ("1", "k", at(0), "a"), ("2", "k", at(1), "b"), ("3", "", at(1), "b"), ("4", "m", at(90), "c"), ("5", "m", at(200), "d")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    once = events.without_repeats(stream, "id", "at")
    events.run_to_table(once, str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 5
    events.run_to_table(events.latest_states(stream, "key", ["at", "id"], "value"), str(tmp_path / "latest"), str(tmp_path / "c2"), "complete").awaitTermination()
    assert {(r["key"], r["state"]) for r in spark.read.parquet(str(tmp_path / "latest/epoch=0")).collect()} == {("k", "b"), ("m", "d")}
    events.run_to_table(events.windowed_counts(stream, "at", "value"), str(tmp_path / "win"), str(tmp_path / "c3")).awaitTermination()
    done = {(r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "win")).collect()}
    assert ("a", 2) in done and ("b", 2) in done


def test_page_caches(spark, tmp_path):
    sha = "a" * 64
    caches = {
        "good": {"sha256": sha.upper(), "pages": [{"pdf_page": 1, "text": "一"}, {"pdf_page": 2, "text": "/Gab /Gcd /G01"}, {"pdf_page": 3, "text": None}, {"pdf_page": 9, "text": "x"}]},
        "twice": {"sha256": "b" * 64, "pages": [{"pdf_page": 1, "text": "x"}, {"pdf_page": 1, "text": "y"}]},
        "other": {"sha256": "c" * 64, "pages": []}, "unbound": {"pages": []}, "shape": {"sha256": sha, "pages": {}},
    }
    for name, c in caches.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(c), encoding="utf-8")
    (tmp_path / "broken.json").write_text("{", encoding="utf-8")
    originals = spark.createDataFrame([(sha, 4), ("b" * 64, 1)], "asset_id string, page_count int")
    got = {(r["source"].rsplit("/", 1)[1][:-5], r["page"]): (r["status"], r["issue"]) for r in files.read_page_caches(spark, str(tmp_path), originals).collect()}
    assert got == {
        ("good", 1): ("partial", None), ("good", 2): ("needs_ocr", "suspect_text_encoding"), ("good", 3): ("failed", "cache_text_invalid"), ("good", 4): ("failed", "cache_page_missing"),
        ("good", 9): ("refused", "CACHE_PAGE_INDEX_INVALID"), ("twice", 1): ("refused", "CACHE_PAGE_INDEX_INVALID"), ("other", None): ("refused", "CACHE_HASH_MISMATCH"),
        ("unbound", None): ("refused", "CACHE_UNBOUND"), ("shape", None): ("refused", "CACHE_INVALID"), ("broken", None): ("refused", "CACHE_INVALID"),
    }


def test_bundle_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), (None, 3, "c"), ("", 4, "d"), ("i", 5, None)], "sha string, id int, name string")
    assert {tuple(r) for r in files.bundle_selection(df, "sha", ["id"]).collect()} == {("h", 1, "a"), ("i", 5, None)}
    files.write_csv(df.selectExpr("id", "array(name, 'x\"y') list", "nullif(name, 'b') name", "'' empty"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', nullValue="\\N")
    assert sorted(map(tuple, back.select("id", "list", "name", "empty").collect()))[0] == ("1", '["a","x\\"y"]', "a", "")
    assert back.where("name is null").count() == 2
