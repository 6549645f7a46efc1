"""Files in, requests checked, Markdown out, the facade and the command line."""

import json

from foliate.cli import doctor, main
from foliate.engine import Engine
from foliate.sources.documents import check_requests, page_text_parser, parse_files, read_files
from foliate.sources.sinks import write_entries, write_markdown, write_metadata


def test_files_and_isolated_failures(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.txt").write_text("three")
    flat = read_files(spark, str(tmp_path), "*.txt")
    assert {r.name for r in flat.collect()} == {"a", "bad"}
    pages = parse_files(read_files(spark, str(tmp_path), "*.txt", recursive=True), page_text_parser, "page_number int, text string").collect()
    assert sorted((r.text or "") for r in pages) == ["", "one", "three", "two"]
    assert sum(r.error is not None for r in pages) == 1


def test_requests(spark):
    rows = [("a.pdf", 1.0, 5), ("a.PDF", 1.0, 11), ("a.doc", 999.0, 999), ("a.pdf", 101.0, 999), ("a.pdf", 1.0, 201), (None, 1.0, 1)]
    made = check_requests(spark.createDataFrame(rows, "filename string, size_mb double, pages int")).collect()
    assert [(r.status_code, r.mode) for r in made] == [(200, "sync"), (200, "async"), (415, "rejected"), (413, "rejected"), (400, "rejected"), (415, "rejected")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\n\nb\n", 3)], "doc_id long, markdown string, pages int")
    write_markdown(docs, str(tmp_path / "md"))
    assert [(r.doc_id, r.markdown, 0 <= r.shard < 64) for r in spark.read.parquet(str(tmp_path / "md")).collect()] == [(1, "# A\n\nb\n", True)]
    write_metadata(docs, str(tmp_path / "meta"), "pages")
    assert json.loads(spark.read.parquet(str(tmp_path / "meta")).first().metadata) == {"pages": 3}
    entries = spark.createDataFrame([("vlm", "k", 1.0, "x")], "tier string, key string, ts double, data string")
    for _ in range(2):
        write_entries(entries, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_facade_and_command_line(spark, tmp_path, capsys):
    from foliate.plans.lifts import pages

    stages = []
    engine = Engine(spark, {"cost_control": {"budget_limit_yuan": 0.1}})
    engine.set_progress_callback(stages.append)
    row = engine.estimate(pages(spark, "/root/testdata/sf0.001")).first()
    assert row.total_pages == 200 and row.allowed is False and stages == ["estimate"]
    try:
        Engine(spark, {"layout": {"confidence_threshold": 3}})
        raise AssertionError
    except ValueError:
        pass
    assert doctor()["pyspark"] == spark.version
    path = str(tmp_path / "c.yaml")
    assert main(["config", "init", path]) == 0 and main(["config", "validate", path]) == 0 and main(["version"]) == 0
    assert "valid" in capsys.readouterr().out


def test_detectors_and_transcribers(spark):
    from foliate.operators.detect import detector, transcribe

    engine = Engine(spark)
    pages = spark.createDataFrame([(1, 1, 300, 900)], "doc_id long, page_number int, width int, height int")
    made = engine.layout(engine.detect(pages), 300).orderBy("reading_order").collect()
    assert [r.block_type for r in made] == ["title", "text", "image"]
    try:
        detector("none")
        raise AssertionError
    except ValueError:
        pass

    class Model:
        def transcribe(self, audio, start):
            if start:
                raise RuntimeError("noise")
            return " hello "

    chunks = spark.createDataFrame([(7, 0, 0), (7, 1, 600)], "video_id long, index long, start int")
    segments = transcribe(chunks, Model)
    assert {(r["index"], r.error) for r in segments.collect()} == {(0, None), (1, "noise")}
    about = spark.createDataFrame([(7, "u", None, "me", 185.0, "seen")], "video_id long, url string, title string, uploader string, duration double, understanding string")
    assert "hello" in engine.audio(about, segments).first().markdown and "3\u52065\u79d2" in engine.audio(about, segments).first().markdown
    assert engine.video(about).first().markdown.endswith("seen\n")
