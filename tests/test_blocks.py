"""Literal cases: suppression, deduplication, merging over pages, assembly, recognition."""

import random
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.operators import images as I
from foliate.operators import layout as L
from foliate.operators import recognize as R
from foliate.operators.assemble import MarkdownConfig, assemble
from foliate.operators.crosspage import merge_pages
from foliate.plans.convert import convert
from foliate.schema import BOX

LAYOUT = f"doc_id long, page_number int, pos int, block_type string, bbox {BOX}, confidence double, column_id int"
BLOCK = f"doc_id long, page_number int, pos int, block_type string, bbox {BOX}, reading_order int, content string, content_type string, image_path string, source string, column_id int"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def layout(spark, *rows):
    return spark.createDataFrame([(1, 1, k, kind, box, conf, None) for k, (kind, box, conf) in enumerate(rows)], LAYOUT)


def blocks(spark, *rows):
    return spark.createDataFrame([(1, page, k, kind, box, order, text, "text", None, "vlm", None) for k, (page, kind, box, order, text) in enumerate(rows)], BLOCK)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common, one, two = max(w, 0) * max(h, 0), (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return common / (one + two - common), common / min(one, two)


@pytest.mark.parametrize("seed", range(3))
def test_suppression_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        x, y = rng.randrange(400), rng.randrange(400)
        rows.append((rng.choice(L.BLOCK_TYPES), (x, y, x + rng.randrange(20, 160), y + rng.randrange(20, 160)), rng.randrange(50, 60) / 100))
    kept = []
    for k, (_, box, _) in sorted(enumerate(rows), key=lambda r: (-r[1][2], r[0])):
        if not any(overlap(box, rows[j][1])[0] > 0.5 or overlap(box, rows[j][1])[1] > 0.7 for j in kept):
            kept.append(k)
    assert {r.pos for r in L.suppress(layout(spark, *rows)).collect()} == set(kept)


def test_order_and_discard(spark):
    rows = layout(spark, ("footer", (0, 900, 600, 950), 0.99), ("table", (40, 500, 500, 800), 0.7), ("caption", (40, 430, 500, 470), 0.8), ("code", (40, 60, 500, 400), 0.55), ("list", (40, 10, 500, 50), 0.3))
    made = L.clean_layout(rows, L.LayoutConfig(merge_adjacent_text=False, detect_columns=False)).orderBy("reading_order").collect()
    assert [(r.block_type, r.reading_order) for r in made] == [("code", 0), ("caption", 1), ("table", 2)]


def test_columns_take_each_pages_own_width(spark):
    rows = [("text", (20, 30, 380, 80), 0.9), ("text", (30, 90, 370, 150), 0.6), ("text", (620, 20, 990, 70), 0.8), ("text", (20, 500, 380, 560), 0.7)]
    wide = spark.createDataFrame([(1, 1, 1000)], "doc_id long, page_number int, width int")
    made = L.clean_layout(layout(spark, *rows), width=wide).orderBy("reading_order").collect()
    assert [(r.column_id, tuple(r.bbox), r.confidence) for r in made] == [(0, (20, 30, 380, 150), 0.6), (0, (20, 500, 380, 560), 0.7), (1, (620, 20, 990, 70), 0.8)]
    unknown = L.clean_layout(layout(spark, *rows), width=wide.filter("width = 0")).collect()
    assert len(unknown) == 3 and {r.column_id for r in unknown} == {None}


def test_deduplication_against_a_loop(spark):
    rng = random.Random(77)
    rows = []
    for k in range(60):
        x, y = rng.randrange(0, 300, 10), rng.randrange(0, 300, 10)
        rows.append((1 + k % 2, "text", (x, y, x + rng.randrange(60, 200), y + rng.randrange(60, 200)), k, "w" * rng.randrange(6)))
    gone = set()
    for i in range(60):
        for j in range(i + 1, 60):
            if rows[i][0] == rows[j][0] and not gone & {i, j} and overlap(rows[i][2], rows[j][2])[1] > 0.6:
                gone.add(j if len(rows[i][4]) >= len(rows[j][4]) else i)
    assert {r.pos for r in B.deduplicate(blocks(spark, *rows)).collect()} == set(range(60)) - gone


def test_paragraphs_go_on_over_pages(spark):
    low, high = (20, 2890, 600, 2960), (20, 30, 600, 90)
    for first, second, want in (("The oak grew", "slowly.", {"The oak grew slowly."}), ("The oak grew.", "Then it fell.", {"The oak grew.", "Then it fell."}), ("Warum？", "Darum", {"Warum？", "Darum"})):
        assert {r.content for r in merge_pages(blocks(spark, (4, "text", low, 0, first), (5, "text", high, 0, second))).collect()} == want
    apart = blocks(spark, (4, "text", low, 0, "no break"), (6, "text", high, 0, "follows"))
    assert merge_pages(apart).count() == 2
    heights = spark.createDataFrame([(1, 4, 12000)], "doc_id long, page_number int, height int")
    assert merge_pages(blocks(spark, (4, "text", low, 0, "high on"), (5, "text", high, 0, "a tall page")), heights).count() == 2
    several = blocks(spark, (1, "formula", low, 0, "a=1"), (1, "formula", low, 1, "b=2"), (2, "formula", high, 0, "c=3"))
    assert sorted(r.content for r in merge_pages(several).collect()) == ["a=1\nc=3", "b=2\nc=3"]


def test_assembly_leaves_marginal_and_blank_blocks_out(spark):
    place = (0, 0, 10, 10)
    rows = blocks(spark, (2, "header", place, 0, "Trees of the north"), (2, "title", (0, 0, 10, 30), 1, "Oak"), (2, "text", place, 2, "\t grows slowly "), (2, "page_number", place, 3, "2"), (3, "footer", place, 0, "x"), (3, "text", place, 1, " \n"), (4, "formula", place, 0, "h = 31"), (4, "reference", place, 1, "[3] Elm")).withColumn("seq", F.col("pos"))
    text = assemble(rows).first().markdown
    assert text == "<!-- Page 2 -->\n\n<!-- Source: page 2, block 1 -->\n## Oak\n\n<!-- Source: page 2, block 2 -->\ngrows slowly\n\n\n\n---\n\n<!-- Page 3 -->\n\n\n\n---\n\n<!-- Page 4 -->\n\n<!-- Source: page 4, block 0 -->\n$$\nh = 31\n$$\n\n\n\n## References\n\n[3] Elm\n"
    bare = assemble(rows, MarkdownConfig("\n***\n", False, False, discard_header_footer=False)).first().markdown
    assert "<!--" not in bare and bare.startswith("Trees of the north\n\n## Oak") and "\n***\n" in bare and "\n2\n" in bare


def test_convert_runs_all_steps(spark):
    rows = blocks(spark, (7, "text", (0, 2800, 500, 2980), 0, "a line that goes"), (7, "text", (4, 2810, 490, 2970), 1, "cover"), (8, "text", (0, 5, 500, 60), 0, "on here."), (8, "footer", (0, 2900, 9, 2999), 1, "foot"))
    made = convert(rows).first().markdown
    assert "a line that goes on here." in made and "cover" not in made and "foot" not in made


class Slow:
    """Answers in capitals; `wrong` always fails, `hangs` never ends, `twice` fails once."""

    def __init__(self):
        self.seen, self.now, self.most, self.lock = {}, 0, 0, threading.Lock()

    def reply(self, prompt, image):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
        time.sleep(30 if prompt == "hangs" else 0.1)
        with self.lock:
            self.now -= 1
        if prompt == "wrong" or prompt == "twice" and self.seen[prompt] == 1:
            raise RuntimeError("no answer")
        return f"{prompt.upper()} {self.most}"


def test_recognition_fails_into_rows_and_runs_side_by_side(spark):
    prompts = ["wrong", "hangs", "twice", *(f"p{k}" for k in range(12))]
    requests = spark.createDataFrame(list(enumerate(prompts)), "request_id int, prompt string").coalesce(1)
    began = time.time()
    made = {r.prompt: r for r in R.recognize(requests, Slow, retries=1, wait=0.0, concurrent=4, timeout=1.0).collect()}
    assert time.time() - began < 25 and len(made) == 15
    assert (made["wrong"].error, made["wrong"].attempts, made["wrong"].reply) == ("no answer", 2, None)
    assert made["hangs"].error.startswith("no answer within") and made["twice"].attempts == 2 and made["twice"].error is None
    assert max(int(r.reply.split()[1]) for r in made.values() if r.reply) > 1


def test_untagged_and_doubled_tags(spark):
    region = "array<struct<region_num:int,bbox:struct<x1:int,y1:int,x2:int,y2:int>,block_type:string>>"
    place = (0, 0, 2, 2)
    rows = [(1, [(1, place, "code")], " x = 1 \n"), (2, [(1, place, "text"), (2, place, "text")], "nothing tagged"), (3, [(2, place, "list"), (1, place, "text")], "hm [REGION_1]\n first [REGION_2] - a [REGION_1] second")]
    made = {(r.doc_id, r.region_num): r.content for r in R.parse_replies(spark.createDataFrame(rows, f"doc_id int, regions {region}, reply string")).collect()}
    assert made == {(1, 1): "x = 1", (2, 1): "", (2, 2): "", (3, 1): "second", (3, 2): "- a"}


def test_densities_are_written_as_printf_does(spark):
    lengths = [51 + k for k in range(200)] + [405, 1234567]
    rows = spark.createDataFrame([(n, "text", (0, 0, 10, side), "x" * n) for n in lengths for side in (80, 100, 70)], f"doc_id long, block_type string, bbox {BOX}, content string")
    got = sorted((r.doc_id, r.bbox.y2, r.validation_warning) for r in R.validate(rows).collect())
    shown = {(n, side): n / (10 * side / 1000.0) for n in lengths for side in (80, 100, 70)}
    assert got == sorted((n, side, f"output too long for area (density={d:.1f})" if d > 50 else "") for (n, side), d in shown.items())
    assert any("506.2" in w for _, _, w in got)  # 506.25


def test_chat_requests():
    import io
    import json

    sent = []

    def open_url(request, timeout):
        sent.append((request, timeout))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "seen"}}]}).encode())

    model = R.ChatRecognizer("http://host/v1/", "key", "m", 0.2, 7, open_url)
    assert model.reply("look", b"\x89PNG") == "seen" and model.reply("read", None) == "seen"
    body = json.loads(sent[0][0].data)
    assert sent[0][0].full_url == "http://host/v1/chat/completions" and sent[0][1] == 7 and sent[0][0].get_header("Authorization") == "Bearer key"
    assert body["model"] == "m" and body["messages"][0]["content"][0]["image_url"]["url"] == "data:image/png;base64,iVBORw==" and body["messages"][0]["content"][1]["text"] == "look"
    assert len(json.loads(sent[1][0].data)["messages"][0]["content"]) == 1


def test_alternative_texts_by_a_model(spark):
    rows = layout(spark, ("image", (0, 0, 500, 500), 0.9), ("image", (0, 600, 20, 620), 0.9), ("image", (600, 0, 990, 400), 0.9), ("caption", (600, 420, 990, 440), 0.9), ("image", (0, 700, 500, 999), 0.9))

    class Model:
        def reply(self, prompt, image):
            if "(0, 700)" in prompt:
                raise RuntimeError("no")
            return " an oak \n"

    made = {r.pos: r.alt_text for r in I.described(I.alt_texts(rows, 1_000_000.0), Model, retries=0).collect()}
    assert made == {0: "an oak", 1: "Page 1, Figure", 2: "caption", 4: "Page 1, Figure"}
