"""The registered queries, by operator; each runs an operator over whole tables and flattens its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import geometry as G
from foliate.functions import markdown as M
from foliate.functions import text as T
from foliate.operators import blocks as B
from foliate.operators import cache as K
from foliate.operators import classify as C
from foliate.operators import crosspage as X
from foliate.operators import dispatch as D
from foliate.operators import images as I
from foliate.operators import layout as L
from foliate.operators import media as V
from foliate.operators import recognize as R
from foliate.operators.assemble import assemble, joined_references, page_before, title_levels
from foliate.plans import lifts
from foliate.plans import oracles as O
from foliate.plans.convert import convert
from foliate.sources.documents import check_requests
from foliate.sources.sinks import image_results, metadata_json
from foliate.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return register


def corners(bbox: str = "bbox", prefix: str = "") -> list[Column]:
    return [F.col(f"{bbox}.{c}").alias(prefix + c) for c in ("x1", "y1", "x2", "y2")]


def to6(x: Column | str) -> Column:
    return F.round(x, 6)


# Text layer -----------------------------------------------------------------------------------------------------------


@query("p01_invalid_ratio", f"WITH {O.PAGES} SELECT doc_id, round({O.INVALID}, 6) AS invalid_ratio FROM pages")
def invalid_ratio(spark, sf):
    return lifts.pages(spark, sf).select("doc_id", to6(T.invalid_ratio(F.col("text"))).alias("invalid_ratio"))


@query("p02_cjk_ratio", f"WITH {O.PAGES} SELECT doc_id, round({O.CJK}, 6) AS cjk_ratio FROM pages")
def cjk_ratio(spark, sf):
    return lifts.pages(spark, sf).select("doc_id", to6(T.cjk_ratio(F.col("text"))).alias("cjk_ratio"))


@query("p03_font_count", f"WITH {O.SPANS} SELECT doc_id, CAST(count(DISTINCT font) AS INTEGER) AS font_count FROM spans GROUP BY doc_id")
def font_count(spark, sf):
    return lifts.pages(spark, sf).select("doc_id", T.font_count(F.transform("spans", lambda s: s["font"])).alias("font_count"))


@query("p04_width_variance", f"WITH {O.SPANS} SELECT doc_id, round(CASE WHEN count(*) FILTER (length(line) > 0) > 1 THEN var_pop(width / length(line)) FILTER (length(line) > 0) ELSE 0 END, 6) AS width_variance FROM spans GROUP BY doc_id")
def width_variance(spark, sf):
    return C.text_metrics(lifts.pages(spark, sf)).select("doc_id", to6("width_variance").alias("width_variance"))


@query("p05_coherence", f"WITH {O.PAGES} SELECT doc_id, round({O.COHERENT}, 6) AS coherence FROM pages")
def coherence(spark, sf):
    return lifts.pages(spark, sf).select("doc_id", to6(T.coherence(F.col("text"))).alias("coherence"))


@query("p06_quality_score", f"WITH {O.METRICS} SELECT doc_id, round(quality_score, 6) AS quality_score FROM scored")
def quality_score(spark, sf):
    return C.text_metrics(lifts.pages(spark, sf)).select("doc_id", to6("quality_score").alias("quality_score"))


@query("p07_image_ratio", f"WITH {O.BOXES} SELECT doc_id, count(*) > 0 AS has_images, round(CAST(sum({O.size('boxes')}) AS DOUBLE) / 1400000, 6) AS image_ratio FROM boxes WHERE block_type = 'image' GROUP BY doc_id")
def image_ratio(spark, sf):
    return C.image_ratio(lifts.boxes(spark, sf), 1400000.0, "doc_id").withColumn("image_ratio", to6("image_ratio"))


@query("p08_formula_font", f"WITH {O.SPANS} SELECT doc_id, bool_or(lower(font) LIKE '%cmmi%') AS has_formula FROM spans GROUP BY doc_id")
def formula_font(spark, sf):
    fonts = F.transform("spans", lambda s: s["font"])
    return lifts.pages(spark, sf).select("doc_id", T.has_formula_font(fonts, C.DetectionConfig().formula_font_patterns).alias("has_formula"))


@query("p09_coverage", f"WITH {O.BOXES} SELECT doc_id, round(CAST(sum({O.size('boxes')}) AS DOUBLE) / 1400000, 6) AS coverage FROM boxes WHERE block_type = 'text' GROUP BY doc_id")
def coverage(spark, sf):
    return C.text_coverage(lifts.boxes(spark, sf), 1400000.0, "doc_id").withColumn("coverage", to6("coverage"))


@query("f01_classify", f"""WITH {O.CLASSIFIED}
SELECT doc_id, page_type, CASE WHEN char_count < 20 THEN 'too few chars (' || char_count || ' < 20)'
  WHEN invalid_ratio > 0.05 THEN 'high invalid char ratio (' || (CAST(round(invalid_ratio * 10000) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(invalid_ratio * 10000) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '%)'
  WHEN quality_score < 0.7 THEN 'low quality score (' || printf('%.2f', round(quality_score, 2)) || ')'
  WHEN image_ratio > 0.3 AND has_formula THEN 'image area ' || CAST(round(image_ratio * 100) AS BIGINT) || '%; formula fonts detected'
  WHEN image_ratio > 0.3 THEN 'image area ' || CAST(round(image_ratio * 100) AS BIGINT) || '%' WHEN has_formula THEN 'formula fonts detected' ELSE 'good text layer' END AS reason
FROM classified""")  # fmt: skip
def classify(spark, sf):
    return C.classify(lifts.pages(spark, sf)).select("doc_id", "page_type", "reason")


@query("f04_route_pages", f"WITH {O.CLASSIFIED} SELECT doc_id, unnest(CASE page_type WHEN 'native' THEN ['native'] WHEN 'mixed' THEN ['scan', 'fallback'] ELSE ['scan'] END) AS branch FROM classified")
def route_pages(spark, sf):
    return C.route_pages(C.classify(lifts.pages(spark, sf))).select("doc_id", "branch")


@query("a01_page_types", f"WITH {O.CLASSIFIED} SELECT page_type, count(*) AS pages FROM classified GROUP BY page_type")
def page_types(spark, sf):
    return C.page_types(C.classify(lifts.pages(spark, sf)))


@query("a10_estimate", f"""WITH {O.CLASSIFIED}, by_group AS (
  SELECT doc_id % 100 AS grp, count(*) AS total_pages, count(*) FILTER (page_type <> 'native') AS scanned, count(*) FILTER (page_type = 'native') AS native, count(*) FILTER (page_type = 'mixed') AS mixed FROM classified GROUP BY 1)
SELECT *, scanned * 6 // 5 AS api_calls, round((scanned * 6 // 5) * 35 / CAST(1000 AS DOUBLE), 2) AS cost, round(((scanned * 6 // 5) * 8 + total_pages * 3) / CAST(10 AS DOUBLE), 1) AS seconds FROM by_group""")  # fmt: skip
def estimate(spark, sf):
    return C.estimate(C.classify(lifts.pages(spark, sf)).withColumn("grp", F.col("doc_id") % 100), "grp")


@query("q11_budget", f"""WITH {O.CLASSIFIED}, calls AS (SELECT doc_id % 100 AS grp, count(*) FILTER (page_type <> 'native') * 6 // 5 AS n FROM classified GROUP BY 1)
SELECT grp, round(n * 35 / CAST(1000 AS DOUBLE), 2) <= 0.2 AS allowed FROM calls""")  # fmt: skip
def budget(spark, sf):
    made = C.estimate(C.classify(lifts.pages(spark, sf)).withColumn("grp", F.col("doc_id") % 100), "grp")
    return C.within_budget(made, 0.2).select("grp", "allowed")


@query("x_types_by_language", f"""WITH {O.CLASSIFIED} SELECT lang, page_type, count(*) AS pages FROM classified JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, page_type)""")
def types_by_language(spark, sf):
    lang = lifts.table(spark, sf, "documents").select("doc_id", "lang")
    return C.classify(lifts.pages(spark, sf)).select("doc_id", "page_type").join(lang, "doc_id").rollup("lang", "page_type").agg(F.count("*").alias("pages"))


# Geometry -------------------------------------------------------------------------------------------------------------

NEIGHBOURS = f"{O.BOXES}, pairs AS (SELECT a.doc_id, a.pos, {O.iou('a', 'b')} AS iou, {O.cont('a', 'b')} AS containment FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.pos = a.pos + 7)"


def neighbours(spark, sf):
    b = lifts.boxes(spark, sf)
    return b.select("doc_id", "pos", F.col("bbox").alias("a")).join(b.select("doc_id", (F.col("pos") - 7).alias("pos"), F.col("bbox").alias("b")), ["doc_id", "pos"])


@query("p10_iou", f"WITH {NEIGHBOURS} SELECT doc_id, pos, round(iou, 6) AS iou FROM pairs")
def iou(spark, sf):
    return neighbours(spark, sf).select("doc_id", "pos", to6(G.iou(F.col("a"), F.col("b"))).alias("iou"))


@query("p11_containment", f"WITH {NEIGHBOURS} SELECT doc_id, pos, round(containment, 6) AS containment FROM pairs")
def containment(spark, sf):
    return neighbours(spark, sf).select("doc_id", "pos", to6(G.containment(F.col("a"), F.col("b"))).alias("containment"))


@query("p12_scale", f"WITH {O.BOXES} SELECT doc_id, pos, {', '.join(f'CAST(trunc({c} * CAST(0.7 AS DOUBLE)) AS INTEGER) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM boxes")
def scale(spark, sf):
    return lifts.boxes(spark, sf).withColumn("bbox", G.scale(F.col("bbox"), 0.7)).select("doc_id", "pos", *corners())


@query("p13_unscale", f"WITH {O.BOXES} SELECT doc_id, pos, {', '.join(f'CAST(trunc({c} / CAST(0.7 AS DOUBLE)) AS INTEGER) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM boxes")
def unscale(spark, sf):
    return lifts.boxes(spark, sf).withColumn("bbox", G.unscale(F.col("bbox"), 0.7)).select("doc_id", "pos", *corners())


@query("p14_expand", f"""WITH {O.BOXES}, grown AS (SELECT *, CAST(trunc(CAST(10 AS DOUBLE) * (CAST(1 AS DOUBLE) - confidence)) AS INTEGER) AS base FROM boxes),
e AS (SELECT *, CASE block_type WHEN 'table' THEN greatest(base, 15) WHEN 'formula' THEN greatest(base, 8) ELSE base END AS e FROM grown)
SELECT doc_id, pos, CAST(greatest(0, x1 - e) AS INTEGER) AS x1, CAST(greatest(0, y1 - e) AS INTEGER) AS y1, CAST(least(x2 + e, 900) AS INTEGER) AS x2, CAST(y2 + e AS INTEGER) AS y2 FROM e""")  # fmt: skip
def expand(spark, sf):
    grown = G.expand(F.col("bbox"), F.col("block_type"), F.col("confidence"), F.lit(900), F.lit(0))
    return lifts.boxes(spark, sf).withColumn("bbox", grown).select("doc_id", "pos", *corners())


@query("p15_downsample", "SELECT p_partkey, CAST(trunc((p_partkey * 7 % 5000) * CAST(0.7 AS DOUBLE)) AS INTEGER) AS w, CAST(trunc((p_partkey * 11 % 7000) * CAST(0.7 AS DOUBLE)) AS INTEGER) AS h FROM part")
def downsample(spark, sf):
    p = lifts.table(spark, sf, "part")
    return p.select("p_partkey", G.downsampled(F.col("p_partkey") * 7 % 5000).alias("w"), G.downsampled(F.col("p_partkey") * 11 % 7000).alias("h"))


@query("p16_split_page", """WITH sizes AS (SELECT p_partkey, CAST(p_partkey * 37 % 15000 + 1 AS INTEGER) AS h FROM part),
starts AS (SELECT p_partkey, h, unnest(CASE WHEN h <= 4000 THEN [0] ELSE range(0, greatest(1, CAST(ceil((h - 3200) / CAST(3000 AS DOUBLE)) AS INTEGER) * 3000 + 1), 3000) END) AS y1 FROM sizes)
SELECT p_partkey, CAST(y1 // 3000 AS INTEGER) AS split_index, CAST(y1 AS INTEGER) AS y1, CAST(CASE WHEN h <= 4000 THEN h ELSE least(y1 + 3200, h) END AS INTEGER) AS y2 FROM starts""")  # fmt: skip
def split_page(spark, sf):
    height = (F.col("p_partkey") * 37 % 15000 + 1).cast("int")
    return lifts.table(spark, sf, "part").select("p_partkey", F.inline(G.splits(height)))


PREPARED = "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 40 AS width, (l_orderkey % 20 + 1) * 60.0 AS height, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_partkey % 240 - 120) / CAST(10 AS DOUBLE) END AS skew, (l_suppkey % 256) / CAST(1 AS DOUBLE) AS luminance FROM lineitem)"


def page_sizes(spark, sf):
    skew = F.when(F.col("l_partkey") % 9 != 0, (F.col("l_partkey") % 240 - 120) / F.lit(10.0))
    return lifts.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).alias("width"), ((F.col("l_orderkey") % 20 + 1) * 60.0).alias("height"), skew.alias("skew"), (F.col("l_suppkey") % 256).cast("double").alias("luminance"))


@query("p17_rotation", PREPARED + " SELECT l_orderkey, l_linenumber, CASE WHEN width > CAST(1.3 AS DOUBLE) * height THEN 90 ELSE 0 END AS rotation FROM p")
def rotation(spark, sf):
    return page_sizes(spark, sf).select("l_orderkey", "l_linenumber", I.rotation(F.col("width"), F.col("height")).alias("rotation"))


@query("p18_deskew", PREPARED + " SELECT l_orderkey, l_linenumber, CASE WHEN skew IS NULL OR abs(skew) < 0.5 OR abs(skew) > 10 THEN CAST(0 AS DOUBLE) ELSE skew END AS angle FROM p")
def deskew(spark, sf):
    return page_sizes(spark, sf).select("l_orderkey", "l_linenumber", I.deskew(F.col("skew")).alias("angle"))


@query("p19_inversion", PREPARED + " SELECT l_orderkey, l_linenumber, luminance < 100 AS is_inverted FROM p")
def inversion(spark, sf):
    return page_sizes(spark, sf).select("l_orderkey", "l_linenumber", I.inverted(F.col("luminance")).alias("is_inverted"))


@query("p20_preprocess", PREPARED + """ SELECT l_orderkey, l_linenumber, CASE WHEN width > CAST(1.3 AS DOUBLE) * height THEN 90 ELSE 0 END AS rotation, luminance < 100 AS is_inverted,
  CASE WHEN width > CAST(1.3 AS DOUBLE) * height THEN CAST(height AS DOUBLE) ELSE width END AS out_width, CASE WHEN width > CAST(1.3 AS DOUBLE) * height THEN width ELSE CAST(height AS DOUBLE) END AS out_height FROM p""")  # fmt: skip
def preprocess(spark, sf):
    return I.preprocess(page_sizes(spark, sf)).select("l_orderkey", "l_linenumber", "rotation", "is_inverted", "out_width", "out_height")


@query("p21_class_map", f"SELECT p_partkey, CASE WHEN p_size % 15 < 12 THEN {O.TYPES}[p_size % 15 + 1] ELSE 'text' END AS block_type FROM part")
def class_map(spark, sf):
    return lifts.table(spark, sf, "part").select("p_partkey", L.class_name(F.col("p_size") % 15).alias("block_type"))


@query("p37_size_default", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 640 ELSE p_size END AS width FROM part")
def size_default(spark, sf):
    given = F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size"))
    return lifts.table(spark, sf, "part").select("p_partkey", G.known_size(given, 640).alias("width"))


@query("p36_base64", "SELECT page_id, md5(base64(encode(html))) AS image_md5 FROM pages")
def base64(spark, sf):
    return lifts.table(spark, sf, "pages").select("page_id", T.text_md5(T.base64_line(F.col("html"))).alias("image_md5"))


# Layout ---------------------------------------------------------------------------------------------------------------


@query("f02_f03_confident", f"WITH {O.BOXES} SELECT doc_id, pos, block_type FROM boxes WHERE confidence >= 0.5 AND block_type NOT IN ('header', 'footer', 'page_number')")
def confident(spark, sf):
    return L.confident(lifts.boxes(spark, sf)).select("doc_id", "pos", "block_type")


def _nms(source: str) -> str:
    return f"""listed AS (SELECT doc_id, list({{'pos': pos, 'block_type': block_type, 'confidence': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY confidence DESC, pos) AS arr FROM {source} GROUP BY doc_id),
kept AS (
  SELECT doc_id, list_reduce(list_transform(arr, lambda s: [s]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: {O.iou('k', '(v[1])')} > 0.5 OR {O.cont('k', '(v[1])')} > 0.7)) > 0 THEN acc ELSE list_concat(acc, v) END) AS kept FROM listed),
suppressed AS (SELECT doc_id, unnest(kept, recursive := true) FROM kept)"""


@query("w04_nms", f"WITH {O.BOXES}, {_nms('boxes')} SELECT doc_id, pos, confidence FROM suppressed")
def nms(spark, sf):
    return L.suppress(lifts.boxes(spark, sf).drop("content")).select("doc_id", "pos", "confidence")


GAPS = f"""{O.LINES}, b AS (
  SELECT doc_id, ln AS pos, CASE WHEN doc_id % 3 = 0 AND ln % 2 = 1 THEN 330 ELSE 20 END AS x1, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN ln % 2 = 1 THEN 580 ELSE 270 END WHEN doc_id % 3 = 1 THEN 580 ELSE 300 END AS x2 FROM lines),
free AS (SELECT d.doc_id, x.x FROM (SELECT doc_id FROM b GROUP BY doc_id) d CROSS JOIN range(180, 421) x(x) WHERE x.x = 420 OR NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND b.x1 <= x.x AND x.x < b.x2)),
covered AS (SELECT d.doc_id, x.x FROM (SELECT doc_id FROM b GROUP BY doc_id) d CROSS JOIN range(180, 420) x(x) WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND b.x1 <= x.x AND x.x < b.x2)),
runs AS (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS grp FROM free WHERE x < 420),
gaps AS (SELECT doc_id, min(x) AS gap_start, max(x) + 1 AS gap_end FROM runs GROUP BY doc_id, grp HAVING max(x) + 1 < 420 AND count(*) >= 30),
best AS (SELECT doc_id, arg_max(gap_start, (gap_end - gap_start) * 1000 - gap_start) AS gap_start, arg_max(gap_end, (gap_end - gap_start) * 1000 - gap_start) AS gap_end FROM gaps GROUP BY doc_id)"""


@query("w10_columns", f"WITH {GAPS} SELECT doc_id, CAST(gap_start AS INTEGER) AS gap_start, CAST(gap_end AS INTEGER) AS gap_end FROM best")
def columns(spark, sf):
    return L.column_gaps(lifts.gap_boxes(spark, sf)).select("doc_id", "gap_start", "gap_end")


@query("j09_assign_columns", f"""WITH {GAPS}
SELECT doc_id, pos, CAST(CASE WHEN n < 2 OR gap_start IS NULL THEN NULL WHEN (x1 + x2) / 2.0 <= gap_start THEN 0 WHEN (x1 + x2) / 2.0 >= gap_end AND (x1 + x2) / 2.0 <= 600 THEN 1 ELSE 0 END AS INTEGER) AS column_id
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM b) LEFT JOIN best USING (doc_id)""")  # fmt: skip
def assign_columns(spark, sf):
    return L.assign_columns(lifts.gap_boxes(spark, sf)).select("doc_id", "pos", "column_id")


COLUMN_BOXES = f"""{O.LINES}, cb AS (
  SELECT doc_id, ln AS pos, CASE WHEN ln % 11 = 10 THEN 'image' ELSE 'text' END AS block_type, (ln % 3) * 200 + (ln * 31) % 40 AS x1, (ln // 3) * 60 AS y1, (ln % 3) * 200 + 100 + (ln * 53 + doc_id) % 90 AS x2,
    (ln // 3) * 60 + 35 + (ln * 17 + doc_id) % 30 AS y2, (50 + (doc_id * 7 + ln * 31) % 50) / CAST(100 AS DOUBLE) AS confidence, ln % 3 AS column_id FROM lines)"""


def _merge(source: str) -> str:
    return f"""texts AS (SELECT doc_id, list({{'c': coalesce(column_id, 0), 'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence, 'column_id': column_id}} ORDER BY coalesce(column_id, 0), y1, pos) AS arr FROM {source} WHERE block_type = 'text' GROUP BY doc_id),
folded AS (
  SELECT doc_id, list_reduce(list_transform(arr, lambda s: [s]), lambda acc, v: CASE WHEN acc[len(acc)].c = v[1].c AND v[1].y1 - acc[len(acc)].y2 BETWEEN 0 AND 20
      AND 2 * (least(acc[len(acc)].x2, v[1].x2) - greatest(acc[len(acc)].x1, v[1].x1)) > least(acc[len(acc)].x2 - acc[len(acc)].x1, v[1].x2 - v[1].x1)
    THEN list_concat(list_slice(acc, 1, len(acc) - 1), [{{'c': acc[len(acc)].c, 'pos': acc[len(acc)].pos, 'x1': least(acc[len(acc)].x1, v[1].x1), 'y1': acc[len(acc)].y1, 'x2': greatest(acc[len(acc)].x2, v[1].x2), 'y2': v[1].y2,
      'confidence': least(acc[len(acc)].confidence, v[1].confidence), 'column_id': acc[len(acc)].column_id}}])
    ELSE list_concat(acc, v) END) AS arr FROM texts),
merged AS (SELECT doc_id, 'text' AS block_type, unnest(arr, recursive := true) FROM folded),
result AS (SELECT doc_id, block_type, x1, y1, x2, y2, confidence, column_id FROM merged UNION ALL SELECT doc_id, block_type, x1, y1, x2, y2, confidence, column_id FROM {source} WHERE block_type <> 'text')"""


@query("w06_merge_text", f"WITH {COLUMN_BOXES}, {_merge('cb')} SELECT doc_id, block_type, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, confidence FROM result")
def merge_text(spark, sf):
    return L.merge_text(lifts.column_boxes(spark, sf)).select("doc_id", "block_type", *corners(), "confidence")


@query("w01_reading_order", f"WITH {COLUMN_BOXES} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY column_id, (y1 + y2) / 2.0, pos) - 1 AS INTEGER) AS reading_order FROM cb")
def reading_order(spark, sf):
    return L.reading_order(lifts.column_boxes(spark, sf)).select("doc_id", "pos", "reading_order")


@query("w02_y_order", f"WITH {O.BOXES} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y1, pos) - 1 AS INTEGER) AS reading_order FROM boxes")
def y_order(spark, sf):
    return L.reading_order(lifts.boxes(spark, sf), "y").select("doc_id", "pos", "reading_order")


@query("m03_clean_layout", f"""WITH {O.BOXES}, good AS (SELECT * FROM boxes WHERE confidence >= 0.5 AND block_type NOT IN ('header', 'footer', 'page_number')), {_nms('good')},
ranked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos) - 1 AS BIGINT) AS pos, block_type, confidence, x1, y1, x2, y2, NULL::BIGINT AS column_id FROM suppressed), {_merge('ranked')}
SELECT doc_id, block_type, count(*) AS blocks, CAST(sum(x1 + y1 + x2 + y2) AS BIGINT) AS corner_sum, round(min(confidence), 6) AS least_confidence FROM result GROUP BY doc_id, block_type""")  # fmt: skip
def clean_layout(spark, sf):
    made = L.clean_layout(lifts.boxes(spark, sf), L.LayoutConfig(detect_columns=False))
    total = F.sum(sum((F.col(f"bbox.{c}").cast("long") for c in ("y1", "x2", "y2")), F.col("bbox.x1").cast("long")))
    return made.groupBy("doc_id", "block_type").agg(F.count("*").alias("blocks"), total.alias("corner_sum"), to6(F.min("confidence")).alias("least_confidence"))


@query("a02_blocks_per_page", f"WITH {O.BOXES} SELECT doc_id, count(*) AS blocks FROM boxes GROUP BY doc_id")
def blocks_per_page(spark, sf):
    return L.blocks_per_page(lifts.boxes(spark, sf), "doc_id")


# Dispatch -------------------------------------------------------------------------------------------------------------


@query("f05_route_regions", f"""WITH {O.BOXES} SELECT doc_id, pos, unnest(CASE WHEN block_type = 'image' THEN ['crop'] WHEN block_type = 'table' THEN ['recognize', 'table_crop']
  WHEN block_type IN ('header', 'footer', 'page_number') THEN []::VARCHAR[] ELSE ['recognize'] END) AS route FROM boxes""")  # fmt: skip
def route_regions(spark, sf):
    return D.route_regions(lifts.boxes(spark, sf)).select("doc_id", "pos", "route")


BATCHES = f"""{O.BOXES}, wanted AS (
  SELECT *, count(*) OVER d AS n, bool_and(block_type IN ('text', 'title')) OVER d AS plain FROM boxes WHERE block_type NOT IN ('image', 'header', 'footer', 'page_number') WINDOW d AS (PARTITION BY doc_id)),
seq AS (SELECT *, n <= 2 AND plain AS simple, CASE WHEN n > 15 THEN 3 ELSE 5 END AS room, CASE WHEN n > 15 THEN 250 ELSE 500 END AS near,
  lag(block_type) OVER o AS before, lag(y2) OVER o AS bottom FROM wanted WINDOW o AS (PARTITION BY doc_id ORDER BY block_type, y1, pos)),
brk AS (SELECT *, CASE WHEN simple THEN 0 WHEN before IS NULL OR before <> block_type OR abs(y1 - bottom) >= near THEN 1 ELSE 0 END AS b FROM seq),
run AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY block_type, y1, pos) AS run FROM brk),
place AS (SELECT *, CASE WHEN simple THEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 ELSE row_number() OVER (PARTITION BY doc_id, run ORDER BY block_type, y1, pos) - 1 END AS place FROM run),
batch AS (SELECT *, CASE WHEN simple THEN 0 ELSE place // room END AS chunk FROM place),
numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY run, chunk) - 1 AS INTEGER) AS request_id, CAST(CASE WHEN simple THEN place ELSE place % room END + 1 AS INTEGER) AS region_num FROM batch)"""


@query("w07_batches", f"WITH {BATCHES} SELECT doc_id, pos, request_id, region_num FROM numbered")
def batches(spark, sf):
    return D.batches(lifts.boxes(spark, sf)).select("doc_id", "pos", "request_id", "region_num")


@query("w08_single_requests", f"WITH {O.BOXES} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS request_id, 1 AS region_num FROM boxes WHERE block_type NOT IN ('image', 'header', 'footer', 'page_number')")
def single_requests(spark, sf):
    return D.single_requests(lifts.boxes(spark, sf)).select("doc_id", "pos", "request_id", "region_num")


_TEMPLATES = {k: v.replace("'", "''") for k, v in D.PROMPTS.items()}
_PROMPT_CASE = "CASE block_type " + " ".join(f"WHEN '{t}' THEN '{_TEMPLATES[k]}'" for t, k in D.PROMPT_KEYS.items()) + f" ELSE '{_TEMPLATES['text']}' END"


@query("p29_prompt", f"WITH {O.BOXES} SELECT doc_id, pos, replace(replace(replace(replace({_PROMPT_CASE}, '{{x1}}', CAST(x1 AS VARCHAR)), '{{y1}}', CAST(y1 AS VARCHAR)), '{{x2}}', CAST(x2 AS VARCHAR)), '{{y2}}', CAST(y2 AS VARCHAR)) AS prompt FROM boxes")
def prompt(spark, sf):
    return lifts.boxes(spark, sf).select("doc_id", "pos", D.prompt(F.col("block_type"), F.col("bbox")).alias("prompt"))


@query("p30_batch_prompt", f"""WITH {BATCHES}, scaled AS (SELECT *, {', '.join(f'CAST(trunc({c} * CAST(0.7 AS DOUBLE)) AS INTEGER) AS s{c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM numbered)
SELECT doc_id, request_id, CAST(count(*) AS INTEGER) AS regions, replace('{_TEMPLATES['batch']}', '{{regions_description}}',
  string_agg('[REGION_' || region_num || '] type=' || block_type || ', box=(' || sx1 || ', ' || sy1 || ') to (' || sx2 || ', ' || sy2 || ')', chr(10) ORDER BY region_num)) AS prompt
FROM scaled GROUP BY doc_id, request_id HAVING count(*) > 1""")  # fmt: skip
def batch_prompt(spark, sf):
    made = D.requests(D.batches(lifts.boxes(spark, sf)))
    return made.filter(F.size("regions") > 1).select("doc_id", "request_id", F.size("regions").alias("regions"), "prompt")


# Recognition ----------------------------------------------------------------------------------------------------------

REPLIES = f"""{O.LINES}, part AS (
  SELECT doc_id, whole // 5 AS rid, whole % 5 AS ln, line, CASE WHEN doc_id % 5 = 0 AND whole % 5 = 1 THEN '' ELSE '[REGION_' || (whole % 5 + 1) || ']' || chr(10) || line || chr(10) END || CASE WHEN doc_id % 6 = 0 AND whole % 5 = 0 THEN '[REGION_1]' || chr(10) || ' again ' || line || ' ' || chr(10) ELSE '' END AS t
  FROM (SELECT doc_id, ln AS whole, line FROM lines)),
reply AS (SELECT doc_id, rid, count(*) AS n, CASE WHEN (doc_id + rid) % 8 = 3 THEN '' ELSE CASE WHEN doc_id % 4 = 0 THEN 'Here it is:' || chr(10) ELSE '' END || string_agg(t, '' ORDER BY ln) END AS reply FROM part GROUP BY doc_id, rid),
cut AS (SELECT doc_id, rid, reply, n, regexp_extract_all(reply, '\\[REGION_(\\d+)\\]', 1) AS tags, list_slice(regexp_split_to_array(reply, '\\[REGION_\\d+\\]'), 2, 99) AS texts FROM reply),
flat AS (SELECT doc_id, rid, unnest(tags) AS tag, unnest(texts) AS txt, generate_subscripts(tags, 1) AS k FROM cut),
last AS (SELECT doc_id, rid, CAST(tag AS INTEGER) AS region_num, arg_max({O.strip('txt')}, k) AS txt FROM flat GROUP BY 1, 2, 3),
parsed AS (
  SELECT part.doc_id, CAST(part.rid AS INTEGER) AS request_id, CAST(part.ln + 1 AS INTEGER) AS region_num, {O.TYPES}[part.ln + 1] AS block_type, part.ln,
    CASE WHEN coalesce(last.txt, '') = '' AND r.n = 1 THEN {O.strip('r.reply')} ELSE coalesce(last.txt, '') END AS content
  FROM part JOIN reply r USING (doc_id, rid) LEFT JOIN last ON last.doc_id = part.doc_id AND last.rid = part.rid AND last.region_num = part.ln + 1)"""


@query("m06_parse_batch", f"WITH {REPLIES} SELECT doc_id, request_id, region_num, content, CASE block_type WHEN 'table' THEN 'markdown_table' WHEN 'formula' THEN 'latex' ELSE 'text' END AS content_type FROM parsed")
def parse_batch(spark, sf):
    return R.parse_replies(lifts.replies(spark, sf)).select("doc_id", "request_id", "region_num", "content", "content_type")


@query("m10_failures", f"""WITH {REPLIES} SELECT doc_id, request_id, region_num, CASE WHEN (doc_id + request_id) % 8 = 3 THEN '[OCR_FAILED: page ' || (doc_id % 3 + 1) || ']' ELSE content END AS content, CASE WHEN (doc_id + request_id) % 8 = 3 THEN 'error' ELSE 'vlm' END AS source,
  CAST(trunc(ln * 10 / CAST(0.7 AS DOUBLE)) AS INTEGER) AS x1, CAST(trunc((ln * 20 + 35) / CAST(0.7 AS DOUBLE)) AS INTEGER) AS y2 FROM parsed""")  # fmt: skip
def failures(spark, sf):
    return R.recognized_blocks(lifts.replies(spark, sf)).select("doc_id", "request_id", "region_num", "content", "source", F.col("bbox.x1").alias("x1"), F.col("bbox.y2").alias("y2"))


@query("a03_counters", f"WITH {O.LINES}, d AS (SELECT DISTINCT doc_id, ln // 5 AS rid FROM lines) SELECT doc_id, count(*) FILTER ((doc_id + rid) % 8 <> 3) AS api_calls, coalesce(string_agg('page ' || (doc_id % 3 + 1) || ': timeout', '; ') FILTER ((doc_id + rid) % 8 = 3), '') AS errors FROM d GROUP BY doc_id")
def counters(spark, sf):
    return R.counters(lifts.replies(spark, sf), "doc_id").withColumn("errors", F.array_join("errors", "; "))


@query("o04_first_errors", f"WITH {O.LINES}, d AS (SELECT DISTINCT doc_id % 10 AS grp, doc_id % 3 + 1 AS page, ln // 5 AS rid, (doc_id + ln // 5) % 8 = 3 AS failed, doc_id FROM lines), r AS (SELECT grp, page, rid, row_number() OVER (PARTITION BY grp ORDER BY page, rid, doc_id) AS k FROM d WHERE failed) SELECT grp, string_agg('page ' || page || ': timeout', '; ') AS errors FROM r WHERE k <= 5 GROUP BY grp")
def first_errors(spark, sf):
    answered = lifts.replies(spark, sf).withColumn("grp", F.col("doc_id") % 10)
    return R.first_errors(answered, "grp").withColumn("errors", F.array_join("errors", "; "))


@query("f09_validate", f"""WITH {O.BOXES}, w AS (
  SELECT doc_id, pos, {O.strip('content')} = '' AS empty, list_filter([CASE WHEN {O.strip('content')} = '' THEN 'empty output' END,
    CASE WHEN length(content) / ({O.size('boxes')} / CAST(1000 AS DOUBLE)) > 50 THEN 'output too long for area (density=' || printf('%.1f', length(content) / ({O.size('boxes')} / CAST(1000 AS DOUBLE))) || ')' END,
    CASE WHEN block_type = 'table' AND NOT contains(content, '|') AND NOT contains(lower(content), '<table') THEN 'table output missing pipe or table tag' END,
    CASE WHEN block_type = 'formula' AND NOT contains(content, '$') AND NOT contains(content, '\\') THEN 'formula output missing LaTeX syntax' END], lambda x: x IS NOT NULL) AS w FROM boxes)
SELECT doc_id, pos, array_to_string(w, '; ') AS validation_warning, NOT empty AND len(w) <= 1 AS validation_passed FROM w""")  # fmt: skip
def validate(spark, sf):
    return R.validate(lifts.boxes(spark, sf)).select("doc_id", "pos", "validation_warning", "validation_passed")


@query("p23_content_type", f"WITH {O.BOXES} SELECT doc_id, pos, CASE block_type WHEN 'table' THEN 'markdown_table' WHEN 'formula' THEN 'latex' ELSE 'text' END AS content_type FROM boxes")
def content_types(spark, sf):
    return lifts.boxes(spark, sf).select("doc_id", "pos", M.content_type(F.col("block_type")).alias("content_type"))


# Native pages ---------------------------------------------------------------------------------------------------------

WEB_SPANS = """found AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<(h1|p|li|b)>([^<]*)<', 1) AS tags, regexp_extract_all(html, '<(h1|p|li|b)>([^<]*)<', 2) AS texts FROM pages),
flat AS (SELECT doc_id, rid, unnest(tags) AS tag, unnest(texts) AS text, generate_subscripts(tags, 1) - 1 AS pos FROM found),
spans AS (
  SELECT doc_id, pos // 2 AS line, pos, text, CASE tag WHEN 'h1' THEN 20.0 WHEN 'li' THEN 11.0 ELSE 12.0 END::DOUBLE AS size, CASE WHEN pos % 7 = 0 THEN '' WHEN pos % 11 = 0 THEN 'CMBX12' ELSE 'Arial' END AS font,
    tag IN ('h1', 'b') AS bold, pos % 5 = 0 AS italic FROM flat)"""
WEB_LINES = WEB_SPANS + f""", joined AS (
  SELECT doc_id, line, {O.strip("string_agg(text, '' ORDER BY pos)")} AS text, arg_max(size, pos) AS font_size, arg_max(font, pos) AS font_name, bool_or(bold) AS is_bold, bool_or(italic) AS is_italic FROM spans GROUP BY doc_id, line),
web AS (SELECT * FROM joined WHERE text <> '')"""


@query("s05_text_lines", f"WITH {WEB_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, text, font_size, font_name, is_bold, is_italic FROM web")
def text_lines(spark, sf):
    return B.text_lines(lifts.page_spans(spark, sf)).drop("page_number")


@query("p22_heading", f"WITH {WEB_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN (is_bold AND font_size > 14) OR font_size > 16 THEN 'title' ELSE 'text' END AS block_type FROM web")
def heading(spark, sf):
    return B.text_lines(lifts.page_spans(spark, sf)).select("doc_id", "line", B.heading(F.col("font_size"), F.col("is_bold")).alias("block_type"))


@query("s06_embedded_images", f"WITH {O.BOXES} SELECT doc_id, min(x1) OVER (PARTITION BY doc_id, pos // 12) AS first_x, x1 FROM boxes WHERE block_type = 'image'")
def embedded_images(spark, sf):
    rects = lifts.boxes(spark, sf).filter("block_type = 'image'").groupBy("doc_id", F.floor(F.col("pos") / 12).alias("xref")).agg(F.collect_list("bbox").alias("rects"), F.min("bbox.x1").alias("first_x"))
    return B.embedded_images(rects).select("doc_id", F.col("first_x").cast("long").alias("first_x"), F.col("bbox.x1").cast("long").alias("x1"))


NATION_CELLS = """rows AS (SELECT n_regionkey AS region, string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE n_name END || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey)"""


@query("s07_table_cells", "SELECT n_regionkey AS region, array_to_string(list_concat(['key,name'], list(n_nationkey || ',' || CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE n_name END ORDER BY n_nationkey)), ';') AS cells FROM nation GROUP BY n_regionkey")
def table_cells(spark, sf):
    cells = B.table_cells(F.col("cells"))
    return lifts.cell_tables(spark, sf).select("region", F.array_join(F.transform(cells, lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query("p25_cells_table", f"WITH {NATION_CELLS} SELECT region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || body AS markdown FROM rows")
def cells_table(spark, sf):
    return lifts.cell_tables(spark, sf).select("region", M.cells_table(F.col("cells")).alias("markdown"))


@query("f06_fallback", f"""WITH {O.BOXES}, s AS (
  SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN 'Times' WHEN doc_id % 13 = 0 THEN 'CMMI10' ELSE 'Arial' END AS font, pos // 3 AS b, CASE WHEN doc_id % 7 = 0 AND pos % 5 = 0 THEN repeat(chr(57344), CAST(length(content) // 10 + 1 AS BIGINT)) || content ELSE content END AS text FROM boxes),
r AS (SELECT doc_id, b, 0 AS kind, pos, 'formula' AS reason FROM s WHERE lower(font) LIKE '%cmmi%' UNION ALL SELECT doc_id, b, 1, pos, 'garbled_text' FROM s WHERE length(text) > 0 AND (length(text) - length(regexp_replace(text, '[\\p{{Co}}]', '', 'g'))) / CAST(length(text) AS DOUBLE) > 0.05)
SELECT doc_id, CAST(b AS INTEGER) AS y1, arg_min(reason, kind * 100000 + pos) AS reason FROM r GROUP BY doc_id, b""")  # fmt: skip
def fallback(spark, sf):
    n, d = F.col("pos"), F.col("doc_id")
    bbox = G.box(F.lit(0), F.floor(n / 3), F.lit(9), F.floor(n / 3) + 1)
    font = F.when(n % 4 == 3, "Times").when(d % 13 == 0, "CMMI10").otherwise("Arial")
    text = F.when((d % 7 == 0) & (n % 5 == 0), F.concat(F.repeat(F.lit("\ue000"), F.floor(F.length("content") / 10).cast("int") + 1), F.col("content"))).otherwise(F.col("content"))
    rows = lifts.boxes(spark, sf).select(*L.PAGE, n, bbox.alias("bbox"), font.alias("font"), text.alias("text"))
    return B.fallback_regions(rows, rows).select("doc_id", F.col("bbox.y1").alias("y1"), "reason")


@query("u03_first_reason", f"WITH {O.BOXES} SELECT doc_id, CAST(x1 // 100 AS INTEGER) AS cell, arg_min(block_type, pos) AS reason FROM boxes WHERE block_type IN ('text', 'formula') GROUP BY 1, 2")
def first_reason(spark, sf):
    rows = lifts.boxes(spark, sf).filter(F.col("block_type").isin("text", "formula")).select("doc_id", F.floor(F.col("bbox.x1") / 100).cast("int").alias("cell"), "pos", "block_type")
    return B.first_reasons(rows.select("doc_id", "cell", F.col("pos").alias("order_"), F.col("block_type").alias("reason")), "doc_id", "cell")


@query("m13_native_blocks", f"""WITH {WEB_LINES}, texts AS (
  SELECT doc_id, 0 AS branch, line AS nth, CASE WHEN (is_bold AND font_size > 14) OR font_size > 16 THEN 'title' ELSE 'text' END AS block_type, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS reading_order, text AS content, '' AS image_path FROM web),
pictures AS (SELECT page_id AS doc_id, 1 AS branch, 1 AS nth, 'image' AS block_type, 0 AS reading_order, '' AS content, 'images/page1_fig1.png' AS image_path FROM pages WHERE page_id % 90 >= 50)
SELECT doc_id, branch, CAST(nth AS INTEGER) AS nth, block_type, CAST(reading_order AS INTEGER) AS reading_order, content, image_path FROM texts UNION ALL SELECT doc_id, branch, nth, block_type, reading_order, content, image_path FROM pictures
UNION ALL SELECT region, 2, 1, 'table', 0, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE n_name END || ' |', chr(10) ORDER BY n_nationkey), ''
  FROM (SELECT *, CAST(n_regionkey AS BIGINT) AS region FROM nation) GROUP BY region""")  # fmt: skip
def native_blocks(spark, sf):
    at = lambda y: G.box(F.lit(0), y, F.lit(100), y + 10)
    lines = B.text_lines(lifts.page_spans(spark, sf)).withColumn("bbox", at(F.col("line")))
    images = lifts.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(1).alias("nth"), (F.col("page_id") % 90).alias("width"), F.lit(80).alias("height"), at(F.lit(0)).alias("bbox"))
    tables = lifts.cell_tables(spark, sf).select(F.col("region").cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(1).alias("nth"), at(F.lit(0)).alias("bbox"), "cells")
    made = B.native_blocks(lines, images, tables)
    return made.select("doc_id", "branch", "nth", "block_type", "reading_order", "content", F.coalesce("image_path", F.lit("")).alias("image_path"))


@query("m12_fallback_blocks", f"WITH {O.BOXES} SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'formula' ELSE 'text' END AS block_type, CASE WHEN pos % 10 = 9 THEN '[OCR_FAILED: page 1]' ELSE content END AS content, CASE WHEN pos % 10 = 9 THEN 'error' ELSE 'vlm_fallback' END AS source FROM boxes")
def fallback_blocks(spark, sf):
    rows = lifts.boxes(spark, sf).withColumns({"reason": F.when(F.col("pos") % 3 == 0, "formula").otherwise("garbled_text"), "error": F.when(F.col("pos") % 10 == 9, "timeout"), "reply": F.col("content")})
    return B.fallback_blocks(rows).drop("bbox", "page_number")


@query("u01_combine", f"""WITH {O.BOXES}, u AS (SELECT doc_id, 0 AS part, pos FROM boxes WHERE pos % 3 = 1 UNION ALL SELECT doc_id, 1, pos FROM boxes WHERE pos % 3 = 0 UNION ALL SELECT doc_id, 2, pos FROM boxes WHERE pos % 3 = 2)
SELECT doc_id, CAST(pos AS INTEGER) AS old_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS INTEGER) AS pos FROM u""")  # fmt: skip
def combine(spark, sf):
    rows = lifts.boxes(spark, sf).withColumn("old_pos", F.col("pos"))
    return B.combine(*(rows.filter(F.col("pos") % 3 == k) for k in (1, 0, 2))).select("doc_id", "old_pos", "pos")


@query("w05_dedup", f"""WITH {O.BOXES}, j AS (
  SELECT a.doc_id, list([a.pos, b.pos, CASE WHEN length(a.content) >= length(b.content) THEN 1 ELSE 0 END] ORDER BY a.pos, b.pos) AS arr
  FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.pos < b.pos AND {O.cont('a', 'b')} > 0.6 GROUP BY a.doc_id),
s AS (SELECT doc_id, unnest(list_reduce(list_prepend([]::BIGINT[], arr), lambda acc, v: CASE WHEN list_contains(acc, v[1]) OR list_contains(acc, v[2]) THEN acc ELSE list_append(acc, CASE WHEN v[3] = 1 THEN v[2] ELSE v[1] END) END)) AS pos FROM j)
SELECT b.doc_id, b.pos FROM boxes b ANTI JOIN s ON b.doc_id = s.doc_id AND b.pos = s.pos""")  # fmt: skip
def dedup(spark, sf):
    return B.deduplicate(lifts.boxes(spark, sf)).select("doc_id", "pos")


# Cross-page merging and assembly --------------------------------------------------------------------------------------


@query("p26_table_columns", f"WITH {O.PAGED} SELECT doc_id, pos, CAST({O.columns('content')} AS INTEGER) AS n_columns FROM paged")
def table_columns(spark, sf):
    return lifts.paged_blocks(spark, sf).select("doc_id", "pos", M.table_columns(F.col("content")).alias("n_columns"))


@query("p27_concat_tables", f"WITH {O.PAGED} SELECT a.doc_id, a.pos, {O.joined_tables('a.content', 'b.content')} AS content FROM paged a JOIN paged b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.content LIKE '| a |%' AND b.content LIKE '| a |%'")
def concat_tables(spark, sf):
    p = lifts.paged_blocks(spark, sf).filter("startswith(content, '| a |')").select("doc_id", "pos", "content")
    after = p.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("two"))
    return p.join(after, ["doc_id", "pos"]).select("doc_id", "pos", M.concat_tables(F.col("content"), F.col("two")).alias("content"))


@query("j01_cross_pairs", f"WITH {O.PAIRS} SELECT doc_id, block_type, pos1, pos2 FROM pairs")
def cross_pairs(spark, sf):
    return X.candidates(lifts.paged_blocks(spark, sf)).select("doc_id", "block_type", "pos1", "pos2")


@query("x01_classify_pairs", f"WITH {O.PAIRS} SELECT doc_id, pos1, pos2, merge_type FROM kinds WHERE merge_type IS NOT NULL")
def classify_pairs(spark, sf):
    return X.classified(X.candidates(lifts.paged_blocks(spark, sf))).select("doc_id", "pos1", "pos2", "merge_type")


@query("x03_cross_merge", f"WITH {O.PAIRS} SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(pos AS INTEGER) AS pos, block_type, content FROM merged")
def cross_merge(spark, sf):
    return X.merge_pages(lifts.paged_blocks(spark, sf)).select("doc_id", "page_number", "pos", "block_type", "content")


@query("p28_title_levels", f"""WITH {O.PAGED}, t AS (SELECT *, y2 - y1 AS h, min(y2 - y1) OVER (PARTITION BY doc_id) AS lo, max(y2 - y1) OVER (PARTITION BY doc_id) AS hi FROM paged WHERE block_type = 'title')
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN lo = hi THEN 2 WHEN (h - lo) / CAST(hi - lo AS DOUBLE) > 0.75 THEN 1 WHEN (h - lo) / CAST(hi - lo AS DOUBLE) > 0.5 THEN 2 WHEN (h - lo) / CAST(hi - lo AS DOUBLE) > 0.25 THEN 3 ELSE 4 END AS level FROM t""")  # fmt: skip
def levels(spark, sf):
    return title_levels(lifts.paged_blocks(spark, sf)).select("doc_id", "pos", "level")


@query("p24_block_markdown", f"""WITH {O.BOXES}, m AS (SELECT *, {O.strip('content')} AS t, CASE WHEN pos % 3 = 0 THEN 'images/page1_fig' || pos || '.png' ELSE '' END AS path FROM boxes)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN t = '' THEN CASE WHEN path = '' THEN '' ELSE '![](images/page1_fig' || pos || '.png)' END WHEN block_type = 'title' THEN '## ' || t WHEN block_type = 'image' THEN '![' || t || '](' || path || ')'
  WHEN block_type = 'formula' AND NOT starts_with(t, '$$') THEN '$$' || chr(10) || t || chr(10) || '$$' WHEN block_type = 'caption' THEN '*' || t || '*' WHEN block_type = 'code' AND NOT starts_with(t, '```') THEN '```' || chr(10) || t || chr(10) || '```' ELSE t END AS markdown FROM m""")  # fmt: skip
def block_markdown(spark, sf):
    path = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("images/page1_fig"), F.col("pos").cast("string"), F.lit(".png")))
    return lifts.boxes(spark, sf).select("doc_id", "pos", M.block_markdown(F.col("block_type"), F.col("content"), path, F.lit(2)).alias("markdown"))


PLAIN = f"{O.PAGED}, plain AS (SELECT doc_id, page_number, pos, block_type, y2 - y1 AS height, reading_order, content, 1 AS o, pos AS sa, 0 AS sb FROM paged)"


def sequenced(spark, sf):
    return lifts.paged_blocks(spark, sf).withColumn("seq", F.struct(F.lit(1).alias("o"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))


@query("x04_assemble", f"WITH {PLAIN}, {O.assembled('plain')} SELECT doc_id, markdown FROM docs")
def assemble_documents(spark, sf):
    return assemble(sequenced(spark, sf))


@query("convert", f"WITH {O.DEDUPLICATED_PAIRS}, {O.assembled('merged')} SELECT doc_id, markdown FROM docs")
def convert_documents(spark, sf):
    return convert(lifts.paged_blocks(spark, sf), order="y")


@query("u05_references", f"WITH {O.PAGED} SELECT doc_id, string_agg(content, chr(10) ORDER BY page_number, reading_order, pos) AS refs FROM paged WHERE block_type = 'reference' GROUP BY doc_id")
def references(spark, sf):
    rows = lifts.paged_blocks(spark, sf).filter("block_type = 'reference'")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "pos", "content"))).alias("r"))
    return listed.select("doc_id", joined_references("r", "\n").alias("refs"))


@query("w09_page_markers", f"WITH {PLAIN}, {O.assembled('plain')} SELECT doc_id, CAST(pos AS INTEGER) AS pos, page_number <> before AS turned FROM body")
def page_markers(spark, sf):
    rows = lifts.paged_blocks(spark, sf).filter("block_type <> 'reference'")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "pos"))).alias("body"))
    turned = F.transform("body", lambda x, i: F.struct(x["pos"].alias("pos"), (x["page_number"] != page_before("body", i)).alias("turned")))
    return listed.select("doc_id", F.inline(turned))


@query("k02_metadata", "SELECT page_id, '{\"url\":' || to_json(url) || ',\"size\":' || length(html) || ',\"note\":null}' AS metadata FROM pages")
def metadata(spark, sf):
    rows = lifts.table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("size"), F.lit(None).cast("string").alias("note"))
    return rows.select("page_id", metadata_json("url", "size", "note").alias("metadata"))


# Pictures -------------------------------------------------------------------------------------------------------------

CROPS = f"""{O.BOXES}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_type ORDER BY pos) AS n FROM boxes WHERE block_type IN ('image', 'table')),
crops AS (
  SELECT doc_id, pos, 'page1_' || CASE block_type WHEN 'image' THEN 'fig' ELSE 'table' END || n || '.png' AS filename, greatest(0, x1 - 5) AS x1, greatest(0, y1 - 5) AS y1, least(850, x2 + 5) AS x2, least(950, y2 + 5) AS y2
  FROM c WHERE block_type = 'table' OR (x2 - x1 >= 50 AND y2 - y1 >= 50))"""


@query("k03_k04_crops", f"WITH {CROPS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, filename, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2 FROM crops")
def crops(spark, sf):
    return I.crop_manifest(lifts.boxes(spark, sf), 850, 950).select("doc_id", "pos", "filename", *corners("crop"))


@query("k05_embedded", "SELECT page_id AS doc_id, 'page1_fig' || (page_id % 5 + 1) || '.png' AS filename FROM pages WHERE page_id * 13 % 100 >= 50")
def embedded(spark, sf):
    rows = lifts.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("page_id") % 5 + 1).alias("nth"), (F.col("page_id") * 13 % 100).alias("width"), F.lit(60).alias("height"))
    return I.embedded_manifest(rows).select("doc_id", "filename")


@query("k07_listing", f"WITH {CROPS} SELECT doc_id, string_agg(filename || ':' || (x2 - x1) || 'x' || (y2 - y1), ',' ORDER BY filename) AS images FROM crops GROUP BY doc_id")
def listing(spark, sf):
    made = I.crop_manifest(lifts.boxes(spark, sf), 850, 950).withColumns({"width": F.col("crop.x2") - F.col("crop.x1"), "height": F.col("crop.y2") - F.col("crop.y1")})
    shown = F.transform("images", lambda i: F.concat(i["filename"], F.lit(":"), i["width"].cast("string"), F.lit("x"), i["height"].cast("string")))
    return I.listing(made).select("doc_id", F.array_join(shown, ",").alias("images"))


@query("p34_image_results", f"WITH {CROPS} SELECT doc_id, string_agg('/api/v1/files/task-' || doc_id || '/images/' || filename, ',' ORDER BY filename) AS urls FROM crops GROUP BY doc_id")
def image_urls(spark, sf):
    made = I.listing(I.crop_manifest(lifts.boxes(spark, sf), 850, 950).withColumns({"width": F.lit(1), "height": F.lit(1)}))
    found = image_results(F.col("images"), F.concat(F.lit("task-"), F.col("doc_id").cast("string")))
    return made.select("doc_id", F.array_join(F.transform(found, lambda i: i["url"]), ",").alias("urls"))


@query("p33_alt_text", f"""WITH {O.BOXES}, near AS (SELECT DISTINCT i.doc_id, i.pos FROM boxes i JOIN boxes c ON i.doc_id = c.doc_id AND i.block_type = 'image' AND c.block_type = 'caption' AND least(abs(c.y1 - i.y2), abs(i.y1 - c.y2)) < 50)
SELECT b.doc_id, CAST(b.pos AS INTEGER) AS pos, CASE WHEN n.pos IS NOT NULL THEN 'caption' WHEN {O.size('b')} / CAST(200000 AS DOUBLE) > 0.1 THEN '' ELSE 'Page 1, Figure' END AS alt_text, n.pos IS NULL AND {O.size('b')} / CAST(200000 AS DOUBLE) > 0.1 AS needs_model
FROM boxes b LEFT JOIN near n ON b.doc_id = n.doc_id AND b.pos = n.pos WHERE b.block_type = 'image'""")  # fmt: skip
def alt_text(spark, sf):
    return I.alt_texts(lifts.boxes(spark, sf), 200000).select("doc_id", "pos", "alt_text", "needs_model")


# Audio and video ------------------------------------------------------------------------------------------------------

VIDEOS = """v AS (
  SELECT DISTINCT conv_id AS video_id, 'https://video.example/' || conv_id AS url, CASE WHEN conv_id % 5 <> 0 THEN 'talk ' || conv_id END AS title, CASE WHEN conv_id % 3 <> 0 THEN 'u' || (conv_id % 10) END AS uploader,
    CASE WHEN conv_id % 7 <> 6 THEN (conv_id * 60) % 4200 END AS duration FROM conversations)"""


@query("w12_frames", f"WITH {VIDEOS} SELECT video_id, array_to_string(CASE WHEN duration > 0 THEN list_slice(range(0, CAST(duration AS BIGINT), 30), 1, 20) ELSE [] END, ',') AS times FROM v")
def frames(spark, sf):
    return lifts.recordings(spark, sf).select("video_id", F.array_join(V.frame_times(F.col("duration")).cast("array<string>"), ",").alias("times"))


@query("w13_chunks", f"WITH {VIDEOS} SELECT video_id, array_to_string(CASE WHEN duration IS NULL OR duration <= 600 THEN [0] ELSE range(0, CAST(duration AS BIGINT), 600) END, ',') AS starts FROM v")
def chunks(spark, sf):
    return lifts.recordings(spark, sf).select("video_id", F.array_join(V.chunk_starts(F.col("duration")).cast("array<string>"), ",").alias("starts"))


@query("s13_duration", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size + CAST(0.5 AS DOUBLE) END AS duration FROM part")
def durations(spark, sf):
    probe = F.when(F.col("p_size") % 4 == 0, "N/A").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5\n")))
    return lifts.table(spark, sf, "part").select("p_partkey", V.duration_of(T.strip(probe)).alias("duration"))


TRANSCRIPTS = f"""{VIDEOS}, seg AS (SELECT conv_id AS video_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE {O.strip('text')} END AS t FROM conversations),
tr AS (SELECT video_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS transcript, count(*) AS segments FROM seg WHERE t <> '' GROUP BY video_id)"""


@query("a08_transcripts", f"WITH {TRANSCRIPTS} SELECT video_id, transcript, segments FROM tr")
def transcripts(spark, sf):
    return V.transcripts(lifts.segments(spark, sf))


HEAD = "'# ' || coalesce(title, '未知') || ' — {}' || chr(10) || chr(10) || '> 视频来源：' || url || chr(10) || '> UP主：' || coalesce(uploader, '未知') || chr(10) || '> 时长：' || (coalesce(duration, 0) // 60) || '分' || (coalesce(duration, 0) % 60) || '秒' || chr(10)"


@query("k09_audio_markdown", f"WITH {TRANSCRIPTS} SELECT video_id, {HEAD.format('音频转录')} || chr(10) || '---' || chr(10) || chr(10) || transcript || chr(10) AS markdown FROM v JOIN tr USING (video_id)")
def audio_markdown(spark, sf):
    rows = lifts.recordings(spark, sf).join(V.transcripts(lifts.segments(spark, sf)), "video_id")
    return rows.select("video_id", V.audio_markdown(F.col("url"), F.col("title"), F.col("uploader"), F.col("duration"), F.col("transcript")).alias("markdown"))


@query("p32_video_markdown", f"WITH {VIDEOS} SELECT video_id, {HEAD.format('视频理解')} || '> 分析帧数：' || least(20, CAST(ceil(coalesce(duration, 0) / CAST(30 AS DOUBLE)) AS INTEGER)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'seen' || chr(10) AS markdown FROM v")
def video_markdown(spark, sf):
    made = V.video_markdown(F.col("url"), F.col("title"), F.col("uploader"), F.col("duration"), F.size(V.frame_times(F.col("duration"))), F.lit("seen"))
    return lifts.recordings(spark, sf).select("video_id", made.alias("markdown"))


# Sources and service --------------------------------------------------------------------------------------------------


@query("s03_page_range", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_partkey % 60 + 1), [p_size % 7 + 1, 8]))), ',') AS pages FROM part")
def page_range(spark, sf):
    spec = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 60).cast("string"), F.lit(","), (F.col("p_size") % 7 + 1).cast("string"), F.lit(",8"))
    return lifts.table(spark, sf, "part").select("p_partkey", F.array_join(T.page_list(spec).cast("array<string>"), ",").alias("pages"))


@query("s04_select_pages", "SELECT p_partkey, array_to_string(CASE WHEN p_size % 5 = 0 THEN range(0, p_size) ELSE list_transform(list_filter([p_size, 40, 2, 0], lambda p: p BETWEEN 1 AND 30), lambda p: p - 1) END, ',') AS indices FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def select_pages(spark, sf):
    asked = F.when(F.col("p_size") % 5 != 0, F.array(F.col("p_size"), F.lit(40), F.lit(2), F.lit(0)))
    total = F.when(F.col("p_size") % 5 == 0, F.col("p_size")).otherwise(30)
    return lifts.table(spark, sf, "part").select("p_partkey", F.array_join(T.select_pages(asked, total).cast("array<string>"), ",").alias("indices"))


@query("s12_md5", "SELECT page_id, md5(html) AS md5 FROM pages")
def md5(spark, sf):
    return lifts.table(spark, sf, "pages").select("page_id", T.text_md5(F.col("html")).alias("md5"))


@query("f11_limits", """WITH r AS (SELECT o_orderkey AS request_id, o_orderkey % 17 = 0 AS other, o_orderkey % 130 AS mb, o_custkey % 260 + 1 AS pages FROM orders),
c AS (SELECT *, CASE WHEN other THEN 415 WHEN mb > 100 THEN 413 WHEN pages > 200 THEN 400 ELSE 200 END AS status_code FROM r)
SELECT request_id, status_code, CASE WHEN status_code <> 200 THEN 'rejected' WHEN pages <= 10 THEN 'sync' ELSE 'async' END AS mode FROM c""")  # fmt: skip
def limits(spark, sf):
    return check_requests(lifts.upload_requests(spark, sf)).select("request_id", "status_code", "mode")


# Cache ----------------------------------------------------------------------------------------------------------------

ENTRIES = "e AS (SELECT ['layout', 'vlm', 'document'][event_id % 3 + 1] AS tier, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS ts, props AS data, CASE event_id % 3 WHEN 0 THEN 86400 WHEN 1 THEN 604800 ELSE 2592000 END AS ttl FROM events)"


@query("f10_ttl", f"WITH {ENTRIES} SELECT tier, count(*) AS entries FROM e WHERE 1706659200 - ts < ttl GROUP BY tier")
def ttl(spark, sf):
    held = lifts.cache_entries(spark, sf).filter(F.lit(lifts.NOW) - F.col("ts") < K._ttl(K.TTL))
    return held.groupBy("tier").agg(F.count("*").alias("entries"))


@query("c05_latest", f"WITH {ENTRIES} SELECT tier, key, max(ts) AS ts FROM e GROUP BY tier, key")
def cache_latest(spark, sf):
    return K.latest(lifts.cache_entries(spark, sf)).select("tier", "key", "ts")


@query("c04_valid", f"WITH {ENTRIES}, l AS (SELECT tier, key, max(ts) AS ts, any_value(ttl) AS ttl FROM e GROUP BY tier, key) SELECT tier, key FROM l WHERE 1706659200 - ts < ttl")
def cache_valid(spark, sf):
    return K.valid(lifts.cache_entries(spark, sf), lifts.NOW).select("tier", "key")


@query("a12_cleanup", f"WITH {ENTRIES} SELECT tier, count(*) FILTER (1706659200 - ts > ttl) AS removed FROM e GROUP BY tier")
def cache_cleanup(spark, sf):
    return K.cleanup(lifts.cache_entries(spark, sf), lifts.NOW)[1]


@query("c06_clear", f"WITH {ENTRIES} SELECT tier, count(*) AS removed FROM e WHERE tier = 'vlm' GROUP BY tier")
def cache_clear(spark, sf):
    return K.clear(lifts.cache_entries(spark, sf), "vlm")[1]


@query("j06_cache_split", f"""WITH {ENTRIES}, l AS (SELECT key, max(ts) AS ts FROM e WHERE tier = 'vlm' GROUP BY key HAVING 1706659200 - max(ts) < 604800)
SELECT c_custkey, c_custkey IN (SELECT CAST(key AS BIGINT) FROM l) AS hit FROM customer""")  # fmt: skip
def cache_split(spark, sf):
    wanted = lifts.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    hits, misses = K.split_cached(wanted, lifts.cache_entries(spark, sf), "vlm", lifts.NOW)
    return hits.select("c_custkey", F.lit(True).alias("hit")).unionByName(misses.select("c_custkey", F.lit(False).alias("hit")))


@query("c01_c03_keys", f"""WITH {O.BOXES}, m AS (SELECT doc_id, md5(text) AS h FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5('layout:' || h || ':1') AS layout_key, md5('vlm:' || h || ':1:(' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || '):' || block_type || ':m') AS vlm_key, md5('doc:' || h || ':c') AS document_key FROM boxes JOIN m USING (doc_id)""")  # fmt: skip
def cache_keys(spark, sf):
    docs = lifts.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    rows = lifts.boxes(spark, sf).drop("content").join(docs, "doc_id")
    page, h = F.col("page_number"), F.col("h")
    return rows.select("doc_id", "pos", K.digest(K.layout_key(h, page)).alias("layout_key"), K.digest(K.vlm_key(h, page, F.col("bbox"), F.col("block_type"), F.lit("m"))).alias("vlm_key"), K.digest(K.document_key(h, "c")).alias("document_key"))


# Task events ----------------------------------------------------------------------------------------------------------

TASKS = "t AS (SELECT event_id, user_id AS task_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'created' ELSE 'progress' END AS kind FROM events)"


@query("t04_task_state", f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS late, kind IN ('completed', 'failed') AS done FROM t),
f AS (SELECT task_id, kind, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM r WHERE done)
SELECT l.task_id, coalesce(f.kind, 'processing') AS status, c.events FROM (SELECT * FROM r WHERE late = 1) l JOIN (SELECT task_id, count(*) AS events FROM t GROUP BY 1) c USING (task_id) LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (task_id)""")  # fmt: skip
def task_state(spark, sf):
    return E.latest_state(lifts.task_events(spark, sf)).select("task_id", "status", "events")


@query("w11_heartbeats", f"""WITH {TASKS}, s AS (SELECT event_id, task_id, kind, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 600 AS us FROM t),
g AS (SELECT *, us - lag(us) OVER o AS gap, coalesce(max(CASE WHEN kind IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM s WINDOW o AS (PARTITION BY task_id ORDER BY us, event_id))
SELECT event_id, task_id, kind, CAST(coalesce(gap // 30000000, 0) AS BIGINT) AS heartbeats FROM g WHERE ended = 0""")  # fmt: skip
def heartbeats(spark, sf):
    return E.heartbeats(lifts.task_events(spark, sf, 600)).select("event_id", "task_id", "kind", "heartbeats")


@query("t07_windows", f"WITH {TASKS} SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, kind, count(*) AS events FROM t GROUP BY 1, 2")
def windows(spark, sf):
    return E.windowed_counts(lifts.task_events(spark, sf)).select(F.unix_micros("start").alias("start_us"), "kind", "events")


@query("t07_sessions", f"""WITH {TASKS}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM t),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM m) SELECT task_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY task_id, n""")  # fmt: skip
def session_counts(spark, sf):
    return E.sessions(lifts.task_events(spark, sf), "12 hours").select("task_id", F.unix_micros("start").alias("start_us"), "events")
