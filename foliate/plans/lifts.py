"""Engine tables made from the synthetic ones, in integer arithmetic that any SQL engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions.geometry import box
from foliate.schema import BLOCK_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ln (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def _type(index) -> F.Column:
    return F.get(F.array(*map(F.lit, BLOCK_TYPES)), index.cast("int"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected regions: a page for each document, a region for each line."""
    d, n = F.col("doc_id"), F.col("ln")
    x, y = (d * 37 + n * 191) % 600, (d * 13 + n * 83) % 900
    made = box(x, y, x + 100 + (n * 53 + d) % 300, y + 30 + (n * 29) % 120)
    return lines(spark, sf_dir).select(d, F.lit(1).alias("page_number"), n.alias("pos"), _type(n % 12).alias("block_type"), made.alias("bbox"), ((50 + (d * 7 + n * 31) % 50) / F.lit(100.0)).alias("confidence"), F.col("line").alias("content"))


def column_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions in three ragged columns, close enough to merge in parts."""
    d, n = F.col("doc_id"), F.col("ln")
    c, row = n % 3, F.floor(n / 3)
    x, y = c * 200 + (n * 31) % 40, row * 60
    made = box(x, y, c * 200 + 100 + (n * 53 + d) % 90, y + 35 + (n * 17 + d) % 30)
    kind = F.when(n % 11 == 10, "image").otherwise("text")
    return lines(spark, sf_dir).select(d, F.lit(1).alias("page_number"), n.alias("pos"), kind.alias("block_type"), made.alias("bbox"), ((50 + (d * 7 + n * 31) % 50) / F.lit(100.0)).alias("confidence"), c.cast("int").alias("column_id"))


def gap_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 600 wide, by document: two columns, one column, or a gap that no box closes."""
    d, n = F.col("doc_id"), F.col("ln")
    x1 = F.when((d % 3 == 0) & (n % 2 == 1), 330).otherwise(20)
    x2 = F.when(d % 3 == 0, F.when(n % 2 == 1, 580).otherwise(270)).when(d % 3 == 1, 580).otherwise(300)
    return lines(spark, sf_dir).select(d, F.lit(1).alias("page_number"), n.alias("pos"), F.lit("text").alias("block_type"), box(x1, n * 20, x2, n * 20 + 15).alias("bbox"), F.lit(0.9).alias("confidence"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, with damaged or ideographic characters in some, spans, fonts and an image share."""
    d = F.col("doc_id")
    damaged = F.concat("text", F.repeat(F.lit("\x01"), (d % 5 * 2 * F.floor(F.length("text") / 100)).cast("int")), F.lit("\ue000\u200b"))
    text = F.when(d % 7 == 0, damaged).when(d % 11 == 0, F.concat("text", F.lit("漢字文"))).otherwise(F.col("text"))
    font = F.when(d % 13 == 0, "CMMI10").otherwise("Arial")

    def span(t, n):
        width = 100 + (n * 53 + d) % 300
        return F.struct(t.alias("text"), F.when(n % 4 == 3, F.lit("Times")).otherwise(font).alias("font"), (10 + n % 9).cast("double").alias("size"), ((n % 2) * 16 + (n % 3) * 2).cast("int").alias("flags"), F.lit(0.0).alias("x1"), width.cast("double").alias("x2"))

    spans = F.transform(F.split("text", "\n"), span)
    return table(spark, sf_dir, "documents").select(d, F.lit(1).alias("page_number"), text.alias("text"), spans.alias("spans"), ((d % 10) / F.lit(20.0)).alias("image_ratio"))


def paged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised blocks, eight to a page of height 3000; the last of a page and the first of the next share a type."""
    d, n = F.col("doc_id"), F.col("ln")
    top = (n % 8) * 375
    y2 = F.when((d % 9 == 0) & (n % 8 == 0), 2995).otherwise(top + 375)
    kind = F.get(F.array(*map(F.lit, ("text", "table", "formula", "title"))), ((d + F.floor((n + 1) / 8)) % 4).cast("int"))
    grid = F.concat(F.lit("| a | b |"), F.when((d + n) % 5 == 4, " c |").otherwise(""), F.lit("\n| --- | --- |"), F.when((d + n) % 5 == 4, " --- |").otherwise(""), F.lit("\n| "), n.cast("string"), F.lit(" | "), d.cast("string"), F.lit(" |"), F.when((d + n) % 5 == 4, " x |").otherwise(""))
    text = F.when((d % 2 == 1) & F.col("line").endswith("."), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    content = F.when(kind == "table", grid).otherwise(text)
    return lines(spark, sf_dir).select(
        d, (F.floor(n / 8) + 1).cast("int").alias("page_number"), n.alias("pos"), F.when(n % 17 == 16, "reference").otherwise(kind).alias("block_type"), box(F.lit(0), top + 5, F.lit(600), y2).alias("bbox"),
        (n % 8).cast("int").alias("reading_order"), content.alias("content"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("image_path"), F.lit("vlm").alias("source"), F.lit(0).alias("column_id"),
    )


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the text layer of web pages: a line for each heading, paragraph, item or bold run."""
    found = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|b)>([^<]*)<"), F.lit(2))
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|b)>([^<]*)<"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(tags.alias("t"), found.alias("x"))).alias("n", "e"))
    tag, n = F.col("e.t"), F.col("n")
    size = F.when(tag == "h1", 20.0).when(tag == "li", 11.0).otherwise(12.0)
    flags = F.when(tag.isin("h1", "b"), 16).otherwise(0) + F.when(n % 5 == 0, 2).otherwise(0)
    font = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 11 == 0, "CMBX12").otherwise("Arial")
    return rows.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), F.floor(n / 2).cast("int").alias("line"), n.alias("pos"), F.col("e.x").alias("text"), size.alias("size"), font.alias("font"), flags.alias("flags"))


def cell_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table of nations for each region, with an empty cell."""
    nation = table(spark, sf_dir, "nation")
    row = F.array(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 7 == 0, F.lit(None)).otherwise(F.col("n_name")))
    rows = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select(F.col("n_regionkey").alias("region"), F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "rows").alias("cells"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of five regions each, of all lines, with a model's reply: some tags missing, doubled, or behind a preamble;
    some fail."""
    part = lines(spark, sf_dir).select("doc_id", F.floor(F.col("ln") / 5).cast("int").alias("request_id"), (F.col("ln") % 5).alias("ln"), "line")
    region = F.struct((F.col("ln") + 1).cast("int").alias("region_num"), box(F.col("ln") * 10, F.col("ln") * 20, F.col("ln") * 10 + 70, F.col("ln") * 20 + 35).alias("bbox"), _type(F.col("ln")).alias("block_type"))
    tag = F.concat(F.lit("[REGION_"), (F.col("ln") + 1).cast("string"), F.lit("]\n"))
    text = F.when((F.col("doc_id") % 5 == 0) & (F.col("ln") == 1), "").otherwise(F.concat(tag, F.col("line"), F.lit("\n")))
    text = F.concat(text, F.when((F.col("doc_id") % 6 == 0) & (F.col("ln") == 0), F.concat(F.lit("[REGION_1]\n again "), F.col("line"), F.lit(" \n"))).otherwise(""))
    made = part.groupBy("doc_id", "request_id").agg(F.array_sort(F.collect_list(region)).alias("regions"), F.transform(F.array_sort(F.collect_list(F.struct("ln", text.alias("t")))), lambda x: x["t"]).alias("t"))
    reply = F.concat(F.when(F.col("doc_id") % 4 == 0, "Here it is:\n").otherwise(""), F.array_join("t", ""))
    failed = (F.col("doc_id") + F.col("request_id")) % 8 == 3
    return made.select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("page_number"), "request_id", "regions", F.lit(0.7).alias("downsample_ratio"), F.when(~failed, reply).alias("reply"), F.when(failed, "timeout").alias("error"))


def micros(rows: DataFrame, name: str = "ts") -> F.Column:
    """Microseconds since 1970 of a timestamp, whether or not its type knows a time zone."""
    if rows.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_micros(name)


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tier = F.get(F.array(F.lit("layout"), F.lit("vlm"), F.lit("document")), (e % 3).cast("int"))
    rows = table(spark, sf_dir, "events")
    return rows.select(tier.alias("tier"), F.col("user_id").cast("string").alias("key"), (micros(rows) / F.lit(1000000.0)).alias("ts"), F.col("props").alias("data"), "event_id")


#: 2024-01-31 00:00:00 UTC.
NOW = 1706659200.0


def task_events(spark: SparkSession, sf_dir: str, squeeze: int = 1) -> DataFrame:
    """Events of tasks; squeeze shortens all time spans."""
    kind = F.expr("case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'created' else 'progress' end")
    rows = table(spark, sf_dir, "events")
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.floor((micros(rows) - 1704067200000000) / squeeze).cast("long"))
    return rows.select("event_id", F.col("user_id").alias("task_id"), ts.alias("ts"), kind.alias("kind"))


def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 17 == 0, ".docx").otherwise(".PDF"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), name.alias("filename"), (F.col("o_orderkey") % 130).cast("double").alias("size_mb"), (F.col("o_custkey") % 260 + 1).cast("int").alias("pages"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for each conversation: title, uploader and duration (some unknown)."""
    c = F.col("conv_id")
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(c.alias("video_id"), F.concat(F.lit("https://video.example/"), c.cast("string")).alias("url"), F.when(c % 5 != 0, F.concat(F.lit("talk "), c.cast("string"))).alias("title"), F.when(c % 3 != 0, F.concat(F.lit("u"), (c % 10).cast("string"))).alias("uploader"), F.when(c % 7 != 6, ((c * 60) % 4200).cast("double")).alias("duration"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 3, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("index"), text.alias("text"))
