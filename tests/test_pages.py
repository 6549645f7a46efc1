"""Files to Markdown: the PDF parser, pages through all branches, recordings, archives, tasks."""

import datetime
import io
import sys
import time
import zipfile
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliate.engine import Engine
from foliate.operators import video as W
from foliate.operators.detect import detect
from foliate.sources.pdf import pdf_parser
from foliate.sources.sinks import write_files, zipped
from foliate.streaming import events as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def pdf(*contents, extra=b"", packed=True):
    """A file with a page for each content stream: bold F1, italic F2, a composite font F3 with a map, a picture I1."""
    to_text = b"1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0003> <6F22> endbfrange"
    stream = lambda data: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z := zlib.compress(data)), z) if packed else b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources 3 0 R >>" % (kids, n),
        3: b"<< /Font << /F1 4 0 R /F2 5 0 R /F3 6 0 R >> /XObject << /I1 8 0 R >> >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Italic /FirstChar 65 /Widths [700 700] >>", 6: b"<< /Type /Font /Subtype /Type0 /BaseFont /Song /ToUnicode 7 0 R >>", 7: stream(to_text),
        8: b"<< /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\nx\nendstream",
    }
    for k, content in enumerate(contents):
        objects[10 + 2 * k], objects[11 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k), stream(content)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


PROSE = b" ".join(b"(The oak is a tree that grows in the north number %d.) Tj T*" % k for k in range(6))
NATIVE = b"BT /F1 20 Tf 72 700 Td (Oak \\(1\\)) Tj ET BT /F2 11 Tf 13 TL 72 660 Td " + PROSE + b" [(Second) -300 (line)] TJ ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(packed):
    first, second, third = pdf_parser(pdf(NATIVE, b"q 600 0 0 400 0 0 cm /I1 Do Q", b"BT /F3 12 Tf 1 0 0 1 50 500 Tm <000100020003> Tj 0 -20 Td /F2 10 Tf (AB\\101\\\\) ' ET % end\nBI /W 1 ID xx EI", packed=packed))
    assert first["text"].split("\n")[0] == "Oak (1)" and first["text"].endswith("Second line") and (first["width"], first["height"]) == (600, 800)
    head, *_ = first["spans"]
    assert (head["font"], head["size"], head["flags"], head["x1"], head["line"]) == ("Helvetica-Bold", 20.0, 16, 72.0, 0) and first["spans"][1]["flags"] == 2
    assert second["text"] == "" and second["image_ratio"] == 0.5
    assert third["text"] == "Hi漢漣".replace("漣", chr(0x6F23)) + "\nABA\\" and third["spans"][1]["x2"] - third["spans"][1]["x1"] == pytest.approx(0.7 * 10 * 3 + 5)
    for bad in (b"no pdf", pdf(NATIVE, extra=b"9 0 obj << /Encrypt 3 0 R >> endobj ")):
        with pytest.raises(ValueError):
            pdf_parser(bad)
    assert pdf_parser(b"%PDF-1.4\n%%EOF") == []


def test_object_streams():
    inside = b"1 0 2 33 " + b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >>"
    packed = zlib.compress(inside)
    data = b"%%PDF-1.5\n5 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n3 0 obj\n<< /Type /Page >>\nendobj\n" % (len(packed), packed)
    assert [(p["page_number"], p["width"]) for p in pdf_parser(data)] == [(1, 612.0)]


class Reader:
    def reply(self, prompt, image):
        tags = [line.split("]")[0] + "]" for line in prompt.split("\n") if line.startswith("[REGION_")]
        return "\n".join(f"{t}\nread by the model" for t in tags) if tags else "x = 1 as it stands on the page" if "LaTeX" in prompt else "read alone"


class Broken:
    def detect(self, image, width, height):
        raise RuntimeError("no picture")


def test_folder_of_pdfs_to_markdown(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(NATIVE, b"q 600 0 0 400 0 0 cm /I1 Do Q"))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    engine, told = Engine(spark), []
    engine.set_progress_callback(lambda *x: told.append(x))
    made = {r.path.rsplit("/", 1)[1]: r for r in engine.convert_files(str(tmp_path), recognizer=Reader).collect()}
    text = made["a.pdf"].markdown
    assert "## Oak (1)" in text and "number 3." in text and text.index("<!-- Page 1 -->") < text.index("<!-- Page 2 -->") < text.index("read by the model")
    assert made["bad.pdf"].markdown is None and made["bad.pdf"].error == "not a PDF file"
    assert ("convert", 0, 2) in told and ("convert", 2, 2) in told
    assert engine.submit("validate", engine.files(str(tmp_path)).filter("error is null")).result(60).count() == 2


def test_mixed_pages_and_failing_detectors(spark, tmp_path):
    rows = [
        (1, 1, "The elm has leaves of many shapes and sizes.", 600.0, 800.0, [("The elm has leaves of many shapes and sizes.", "Arial", 12.0, 0, 10.0, 400.0, 10.0, 22.0, 0), ("x=1", "CMMI10", 12.0, 0, 10.0, 40.0, 300.0, 312.0, 1)], 0.0),
        (2, 1, "", 600.0, 800.0, [], 1.0),
    ]
    spans = "array<struct<text:string,font:string,size:double,flags:int,x1:double,x2:double,y1:double,y2:double,line:int>>"
    pages = spark.createDataFrame(rows, f"doc_id long, page_number int, text string, width double, height double, spans {spans}, image_ratio double")
    made = {r.doc_id: r.markdown for r in Engine(spark).convert_pages(pages, Reader).collect()}
    assert "$$\nx = 1 as it stands on the page\n$$" in made[1] and "read by the model" in made[2]
    failed = detect(pages.selectExpr("doc_id", "page_number", "cast(width as int) width", "cast(height as int) height"), Broken).collect()
    assert [(r.block_type, r.confidence, r.bbox.y2) for r in failed] == [("text", 1.0, 800)] * 2


class Shop:
    def fetch(self, url):
        if "gone" in url:
            raise OSError("404")
        return {"path": f"/v/{url}", "title": "Oaks", "uploader": "me", "duration": 65.0}

    def frame(self, path, second):
        if second == 30:
            raise OSError("damaged")
        return f"{path}@{second}".encode()

    def audio(self, path, start, seconds):
        return f"{start}+{seconds}".encode()

    def reply_to_many(self, prompt, images):
        return f"{prompt.split(' at ')[1].split(' seconds')[0]}: {len(images)}"

    def transcribe(self, audio, start):
        return bytes(audio).decode()


def test_recordings(spark):
    urls = spark.createDataFrame([(1, "here"), (2, "gone")], "video_id long, url string")
    fetched = {r.video_id: r for r in W.fetch(urls, Shop, retries=0).collect()}
    assert fetched[1].path == "/v/here" and fetched[2].error == "404" and fetched[2].path is None
    engine = Engine(spark, {"vlm": {"max_retries": 0}, "video": {"audio_chunk_seconds": 40}})
    seen, heard = engine.watch(urls, Shop, Shop, Shop).collect(), engine.watch(urls, Shop, Shop, transcriber=Shop).collect()
    assert [r.video_id for r in seen] == [1] and seen[0].markdown.endswith("0, 60: 2\n")
    assert [r.video_id for r in heard] == [1] and "0+40\n\n40+40" in heard[0].markdown
    nothing = W.understand(spark.createDataFrame([(5, 0, None)], "video_id long, second int, image binary"), Shop).first()
    assert nothing.error == "no frames"


def test_archives_and_files(spark, tmp_path):
    rows = [(1, "# Oak\n", '{"pages":2}', [("fig1.png", b"\x89")]), (2, None, None, None)]
    results = spark.createDataFrame(rows, "doc_id long, markdown string, metadata string, images array<struct<filename:string,content:binary>>")
    made = {r.doc_id: zipfile.ZipFile(io.BytesIO(r.archive)) for r in Engine(spark).archive(results).collect()}
    assert made[1].namelist() == ["document.md", "metadata.json", "images/fig1.png"] and made[1].read("images/fig1.png") == b"\x89" and made[2].read("document.md") == b""
    assert [r.archive for r in zipped(results).orderBy("doc_id").collect()] == [r.archive for r in zipped(results).orderBy("doc_id").collect()]
    assert write_files(results, str(tmp_path / "md")) == 2 and (tmp_path / "md" / "1" / "document.md").read_text() == "# Oak\n"


class Post:
    def post(self, url, payload):
        if url == "down":
            raise OSError("refused")
        if url == "slow":
            time.sleep(20)


def test_tasks_are_cancelled_and_told(spark):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, 1, at, "created"), (2, 1, at, "completed"), (3, 2, at, "progress")], "event_id long, task_id long, ts timestamp, kind string")
    engine = Engine(spark, {"vlm": {"max_retries": 0, "timeout": 1}})
    gone = engine.cancel(events, spark.createDataFrame([(1,), (2,), (3,), (2,)], "task_id long"), F.lit(at)).collect()
    assert [(r.task_id, r.kind) for r in gone] == [(2, "cancelled")]
    assert {r.task_id: r.status for r in engine.status(events).collect()} == {1: "completed", 2: "processing"}
    states = spark.createDataFrame([(1, "completed", "up"), (2, "failed", "down"), (3, "processing", "up"), (4, "completed", None), (5, "completed", "slow")], "task_id long, status string, callback_url string")
    told = {r.task_id: (r.delivered, r.error) for r in engine.notify(states, Post).collect()}
    assert told == {1: (True, None), 2: (False, "refused"), 5: (False, "no answer within 1 s")} and set(E.TERMINAL) == {"completed", "failed", "cancelled"}
