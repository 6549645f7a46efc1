"""Literal cases: geometry, tables, prompts, ranges, configuration, cache."""

import random

import pytest
from pyspark.sql import functions as F

from foliate import config as C
from foliate.functions import geometry as G
from foliate.functions import markdown as M
from foliate.functions import text as T
from foliate.operators import cache as K
from foliate.operators import dispatch as D
from foliate.operators.classify import classify


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def grid(box):
    """The cells that a box of whole numbers covers."""
    return {(x, y) for x in range(box[0], box[2]) for y in range(box[1], box[3])}


def test_overlaps_against_counted_cells(spark):
    rng = random.Random(31)
    pairs = []
    for _ in range(60):
        a, b = ((x, y, x + rng.randrange(9), y + rng.randrange(9)) for x, y in ((rng.randrange(12), rng.randrange(12)) for _ in range(2)))
        pairs.append((*a, *b))
    names = [f"{k}{n}" for k in "ab" for n in ("x1", "y1", "x2", "y2")]
    rows = spark.createDataFrame(pairs, ", ".join(f"{n} int" for n in names))
    a, b = (G.box(*(F.col(f"{k}{n}") for n in ("x1", "y1", "x2", "y2"))) for k in "ab")
    for r in rows.select(*names, G.iou(a, b).alias("iou"), G.containment(a, b).alias("part")).collect():
        one, other = grid(r[:4]), grid(r[4:8])
        common, least = len(one & other), min(len(one), len(other))
        assert r.iou == pytest.approx(common / len(one | other) if common else 0) and r.part == pytest.approx(common / least if common else 0)


def test_sizes(spark):
    assert tuple(one(spark, G.scale(G.box(3, 19, 57, 2003), 0.7))) == (2, 13, 39, 1402)
    assert tuple(one(spark, G.unscale(G.box(2, 13, 39, 1402), 0.5))) == (4, 26, 78, 2804) and tuple(one(spark, G.unscale(G.box(2, 13, 39, 1402), 2.0))) == (2, 13, 39, 1402)
    for height in (1, 3999, 4000, 4001, 6200, 6201, 15000):
        pieces = [(p.split_index, p.y1, p.y2) for p in one(spark, G.splits(F.lit(height)))]
        assert pieces[0][1] == 0 and pieces[-1][2] == height and [p[0] for p in pieces] == list(range(len(pieces)))
        assert all(a[2] - b[1] == 200 for a, b in zip(pieces, pieces[1:])) and (len(pieces) == 1) == (height <= 4000)
    assert one(spark, G.downsampled(F.lit(1001))) == 700 and one(spark, G.downsampled(F.lit(1001), 1.0)) == 1001
    assert one(spark, G.known_size(F.lit(0), 640)) == 640 and one(spark, G.known_size(F.lit(12), 640)) == 12
    assert tuple(one(spark, G.padded(G.box(4, 90, 50, 99), F.lit(52), F.lit(100), 5))) == (0, 85, 52, 100)


def table(rows):
    head, *body = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([head, "| " + " | ".join("---" for _ in rows[0]) + " |", *body])


def test_tables(spark):
    north, south = [["tree", "metres"], ["oak", "31"]], [["tree", "metres"], ["elm", "24"], ["yew", "9"]]
    joined = one(spark, M.concat_tables(F.lit(table(north)), F.lit(table(south))))
    assert joined == table([*north, *south[1:]])
    assert one(spark, M.concat_tables(F.lit(table(north)), F.lit("\n "))) == table(north)
    assert [one(spark, M.table_columns(F.lit(table([["h"] * n, ["x"] * n])))) for n in (1, 2, 7)] == [1, 2, 7]
    assert one(spark, M.cells_table(F.expr("array(array('tree', 'metres'), array('oak', null))"))) == table([["tree", "metres"], ["oak", ""]])
    assert one(spark, M.cells_table(F.expr("cast(array() as array<array<string>>)"))) == ""


def test_text(spark):
    rng = random.Random(8)
    for _ in range(12):
        pages = {rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))}
        spec = [str(p) for p in pages] + [f"{min(pages)}-{min(pages) + 2}", " 7 - 5 "]
        rng.shuffle(spec)
        assert one(spark, T.page_list(F.lit(",".join(spec)))) == sorted(pages | set(range(min(pages), min(pages) + 3)))
    assert one(spark, T.select_pages(F.expr("array(4, 0, 2, 77)"), F.lit(4))) == [3, 1] and one(spark, T.select_pages(F.expr("cast(null as array<int>)"), F.lit(3))) == [0, 1, 2]
    blanks = "\t\x0b \x1c\x85\xa0 　\n"
    assert [one(spark, f(F.lit(f"{blanks}a b{blanks}"))) for f in (T.strip, T.lstrip, T.rstrip)] == ["a b", f"a b{blanks}", f"{blanks}a b"]
    assert one(spark, T.invalid_ratio(F.lit("xyz\n\x02​"))) == pytest.approx(2 / 6) and one(spark, T.invalid_ratio(F.lit(""))) == 0
    assert one(spark, T.base64_line(F.lit("\xff" * 90))).count("\n") == 0


@pytest.mark.parametrize("text", ["", "one two", "a-b c", "... !!! word", "αβγ, 漢字 x_1", "\x01a\x01 b", "  spaced\xa0out　 "])
def test_coherence_against_counts(spark, text):
    import regex

    words, tokens = regex.findall(r"[\p{L}\p{N}_]+", text), text.split()
    assert one(spark, T.coherence(F.lit(text))) == pytest.approx(min(1.0, len(words) / max(len(tokens), 1)))


def test_rounding_of_binary_values(spark):
    values = [0.575, 0.565, 0.285, 0.125, 0.375, 0.005, 0.0, 0.699999, 1.0]
    assert one(spark, F.transform(F.array(*map(F.lit, values)), lambda x: T.decimals(T.rounded(x, 2), 2))) == ["0.57", "0.56", "0.28", "0.13", "0.38", "0.01", "0.00", "0.70", "1.00"]
    assert one(spark, T.decimals(F.lit(1234567.25), 1)) == "1234567.2"


def test_low_scores_are_rounded_in_binary(spark):
    pages = spark.createDataFrame([("word " * 23 + "! " * 17, [], 0.0)], "text string, spans array<struct<text string, font string, x1 double, x2 double>>, image_ratio double")
    made = classify(pages).select("quality_score", "reason").first()
    assert (made.quality_score, made.reason) == (0.575, "low quality score (0.57)")


def test_prompts(spark):
    place = G.box(11, 222, 3333, 44444)
    for kind in ("text", "title", "table", "formula", "caption", "list", "code", "reference", "image", "header"):
        made = one(spark, D.prompt(F.lit(kind), place))
        assert all(str(n) in made for n in (11, 222, 3333, 44444)) and "{" not in made
    assert one(spark, D.prompt(F.lit("list"), place, {"list": "{y2}/{x1}"}, "About trees")) == "About trees\n\n44444/11"
    regions = F.array(*(F.struct(G.box(k, k, k + 1, k + 1).alias("bbox"), F.lit(t).alias("block_type")) for k, t in enumerate(("code", "list", "table"))))
    made = one(spark, D.batch_prompt(regions, {"batch": "<{regions_description}>"}))
    assert [line.split()[0] for line in made.strip("<>").split("\n")] == ["[REGION_1]", "[REGION_2]", "[REGION_3]"] and "code" in made and "(2, 2) to (3, 3)" in made
    assert D.PROMPTS.keys() >= set(D.PROMPT_KEYS.values()) | {"batch", "full_page"}


def test_configuration(tmp_path, monkeypatch):
    base, over = {"tree": {"oak": 1, "elm": {"x": 1}}, "n": 1}, {"tree": {"elm": {"y": 2}}, "n": {"m": 3}}
    assert C.merge(base, over) == {"tree": {"oak": 1, "elm": {"x": 1, "y": 2}}, "n": {"m": 3}} and base["tree"]["elm"] == {"x": 1}
    monkeypatch.setenv("A_TREE", "willow")
    assert C.resolve([{"k": "${A_TREE}"}, "no ${A_TREE}", "${MISSING_TREE}", 7]) == [{"k": "willow"}, "no ${A_TREE}", "", 7]
    made = C.load(str(tmp_path / "none.yaml"))
    assert made == C.DEFAULTS and C.validate(made) == []
    (tmp_path / "c.yaml").write_text("vlm:\n  api_key: ${A_TREE}\n  max_retries: 9\npreprocessing:\n  enable_deskew: false\n  deskew_threshold_degrees: 2\ncost_control:\n  budget_limit_yuan: 3\n")
    made = C.load(str(tmp_path / "c.yaml"), {"layout": {"confidence_threshold": -1}})
    assert (made["vlm"]["api_key"], made["vlm"]["max_retries"], made["preprocessing"]["enable_deskew"]) == ("willow", 9, False) and C.validate(made) == ["layout.confidence_threshold is -1"]
    C.save(made, str(tmp_path / "out.yaml"))
    assert "willow" not in (tmp_path / "out.yaml").read_text()
    assert C.validate({"vlm": {"colour": 1}, "sound": {}}) == ["unknown section sound", "unknown key vlm.colour"]
    assert all(key in C.DEFAULTS[section] for section, key in C.WITHOUT_EFFECT)
    assert K.config_hash({"u": [1], "v": 2}) == K.config_hash({"v": 2, "u": [1]}) != K.config_hash({"u": [2], "v": 2})


def test_cache(spark):
    rows = [("vlm", "oak", 10.0, "first"), ("vlm", "oak", 40.0, "last"), ("vlm", "elm", 0.0, "stale"), ("document", "oak", 5.0, "whole")]
    entries = spark.createDataFrame(rows, "tier string, key string, ts double, data string")
    now = 7 * 86400.0 + 20
    assert {(r.tier, r.data) for r in K.valid(entries, now).collect()} == {("vlm", "last"), ("document", "whole")}
    assert {(r.key, r.ts) for r in K.expired(entries, now).collect()} == {("oak", 10.0), ("elm", 0.0)}
    hits, misses = K.split_cached(spark.createDataFrame([("oak",), ("elm",), ("yew",)], "key string"), entries, "vlm", now)
    assert [(r.key, r.cached) for r in hits.collect()] == [("oak", "last")] and {r.key for r in misses.collect()} == {"elm", "yew"}
    again = K.upsert(entries, misses.selectExpr(f"'vlm' tier", "key", f"cast({now} as double) ts", "'new' data"))
    assert K.split_cached(misses, again, "vlm", now + 1)[1].isEmpty()
    left, removed = K.clear(entries, "vlm")
    assert [r.tier for r in left.collect()] == ["document"] and removed.first().removed == 3


@pytest.mark.parametrize("mode,expected", [("native", {"native"}), (None, {"scanned", "mixed", "native"})])
def test_classification_has_every_branch(spark, mode, expected):
    from foliate.operators.classify import DetectionConfig, classify
    from foliate.plans.lifts import pages

    made = classify(pages(spark, "/root/testdata/sf0.01"), DetectionConfig(force_mode=mode))
    assert {r.page_type for r in made.select("page_type").distinct().collect()} == expected
    if mode is None:
        starts = {r.reason[:8] for r in made.select("reason").collect()}
        assert {"too few ", "high inv", "low qual", "image ar", "formula ", "good tex"} <= starts
