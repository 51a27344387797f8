from __future__ import annotations

from datetime import datetime

from evidara.sources import readers, writers


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "A b.MD").write_bytes("# T\n\nbody \xe9".encode("latin-1"))
    (tmp_path / "page.html").write_text("<h2>T&amp;x</h2><script>no()</script><p>one <b>two</b></p><ul><li>x</li></ul><pre>a\n b</pre>")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {r.name: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a-b.md", "page.html", "scan.pdf"}
    assert got["a-b.md"].text == "# T\n\nbody �" and len(got["a-b.md"].document_id) == 22
    assert got["page.html"].text == "## T&x\n\none two\n\n- x\n\n```\na\n b\n```\n"
    assert got["scan.pdf"].text is None and "no converter" in got["scan.pdf"].error


def test_policy_on_scanned_pages(spark):
    rows = [(1, 3, 0, 0), (2, 3, 3, 1), (3, 3, 1, 0), (4, 3, 1, 1), (5, None, None, 0)]
    df = spark.createDataFrame(rows, "id int, pages int, pages_unread int, skip_ocr_pages int")
    assert {r.id for r in readers.refused(df).collect()} == {2, 3}


def test_bookmarks_claim_headings_once():
    heads = [(1, "1. Intro"), (2, "Method"), (2, "Method")]
    assert readers.bookmarked(heads, [(1, 1, "Intro"), (3, 2, "METHOD"), (2, 2, "Method"), (2, 2, "Method"), (9, 1, "none")]) == [(0, 1), (1, 2), (2, 2)]


def test_replacing_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        writers.replace(rows, path, ["k"])
    writers.replace(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_publishing_never_changes_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert writers.publish_once(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k") == 1
    assert writers.publish_once(spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int"), path, "k") == 1
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    assert writers.statistics(spark, path)["rows"] == 2
    assert writers.schema_matches(spark, path, spark.createDataFrame([], "k string, v int")) and not writers.schema_matches(spark, path, spark.createDataFrame([], "k string"))


def test_audit_is_kept_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, d), "import", "me", "{}") for d in (1, 2, 3)], "at timestamp, action string, actor string, detail string")
    writers.append_audit(rows, f"{tmp_path}/audit")
    assert writers.prune_days(spark, f"{tmp_path}/audit", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert readers.audit(spark, f"{tmp_path}/audit").count() == 1


def test_sweep(spark):
    staged = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 3))], "name string, staged_at timestamp")
    files = spark.createDataFrame([("a",), ("c",)], "name string")
    assert {(r.name, r.why) for r in writers.swept(staged, files, "2024-01-03 12:00:00").collect()} == {("a", "old"), ("c", "orphan")}
