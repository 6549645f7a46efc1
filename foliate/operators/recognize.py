"""Recognition: pluggable backends, reply parsing, validation, failures."""

from __future__ import annotations

import base64
import json
import queue
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import area, unscale
from foliate.functions.markdown import content_type
from foliate.functions.text import decimals, strip
from foliate.operators.layout import PAGE


class Recognizer(Protocol):
    """What a vision model has to offer: the reply to a prompt about a picture."""

    def reply(self, prompt: str, image: bytes | None) -> str: ...


class EchoRecognizer:
    """A stand-in without a model: every region's tag, and the first words of its line in the prompt."""

    def reply(self, prompt: str, image: bytes | None) -> str:
        tags = [line for line in prompt.split("\n") if line.startswith("[REGION_")]
        return "\n".join(f"{line.split(']')[0]}]\n{line.split('] ', 1)[1]}" for line in tags) if tags else prompt


BACKENDS: dict[str, Callable[[], Recognizer]] = {"echo": EchoRecognizer}


def backend(name: str) -> Recognizer:
    if name not in BACKENDS:
        raise ValueError(f"unknown recognition backend {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]()


class ChatRecognizer:
    """A model behind a chat-completions endpoint, one request for each prompt and picture.

    open_url takes a request and a timeout and gives a stream with the answer, as urllib's does.
    """

    def __init__(self, base_url: str, api_key: str, model: str, temperature: float = 0.1, timeout: float = 60, open_url: Callable | None = None):
        self.url, self.api_key, self.model = base_url.rstrip("/") + "/chat/completions", api_key, model
        self.temperature, self.timeout, self.open_url = temperature, timeout, open_url or urllib.request.urlopen

    def body(self, prompt: str, images: list[bytes]) -> dict:
        pictures = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(i).decode()}} for i in images]
        return {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": [*pictures, {"type": "text", "text": prompt}]}]}

    def reply(self, prompt: str, image: bytes | None) -> str:
        return self.reply_to_many(prompt, [] if image is None else [image])

    def reply_to_many(self, prompt: str, images: list[bytes]) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        request = urllib.request.Request(self.url, json.dumps(self.body(prompt, images)).encode(), headers)
        with self.open_url(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]


def within(seconds: float | None, call: Callable, *args):
    """call(*args), or TimeoutError if it takes longer; what hangs is left behind in a thread that ends with the worker."""
    if seconds is None:
        return call(*args)
    made: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            made.put((call(*args), None))
        except Exception as problem:  # noqa: BLE001
            made.put((None, problem))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, problem = made.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if problem:
        raise problem
    return value


def tried(call: Callable, *args, retries: int = 3, wait: float = 1.0, timeout: float | None = None) -> tuple:
    """(value, None, attempts) or (None, error, attempts) of a call that is tried again after wait, 2 wait, 4 wait .. seconds."""
    for attempt in range(retries + 1):
        try:
            return within(timeout, call, *args), None, attempt + 1
        except Exception as problem:  # noqa: BLE001
            error = str(problem) or type(problem).__name__
            if attempt < retries:
                time.sleep(wait * 2**attempt)
    return None, error, retries + 1


def recognize(requests: DataFrame, make: Callable[[], Recognizer], retries: int = 3, wait: float = 1.0, concurrent: int = 1, timeout: float | None = None) -> DataFrame:
    """requests (prompt, image if there is one) with reply, error and attempts.

    A failed or late call is tried again after wait, 2 wait, 4 wait .. seconds; then the error stands in the row and no
    exception leaves the task. A task has up to `concurrent` calls under way at a time, so tasks times that is the load on a
    service. Materialise the result before using it twice.
    """
    image = "image" in requests.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", reply string, error string, attempts int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def ask(prompt: str, picture: bytes | None) -> tuple[str | None, str | None, int]:
            return tried(model.reply, prompt, picture, retries=retries, wait=wait, timeout=timeout)

        for frame in frames:
            with ThreadPoolExecutor(concurrent) as pool:
                made = list(pool.map(ask, frame["prompt"], frame["image"] if image else [None] * len(frame)))
            yield frame.assign(reply=[m[0] for m in made], error=[m[1] for m in made], attempts=[m[2] for m in made])

    return requests.mapInPandas(run, schema)


def reply_parts(reply: Column) -> Column:
    """region number -> stripped content of a tagged reply; of equal numbers the last counts, text before tags doesn't."""
    tags = F.regexp_extract_all(reply, F.lit(r"\[REGION_(\d+)\]"), F.lit(1))
    contents = F.slice(F.split(reply, r"\[REGION_\d+\]"), 2, F.greatest(F.size(tags), F.lit(1)))
    entries = F.transform(F.arrays_zip(tags.alias("k"), contents.alias("v")), lambda e: F.struct(e["k"].cast("int").alias("key"), strip(e["v"]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_replies(answered: DataFrame) -> DataFrame:
    """A row for each region of answered requests (regions, reply): region_num, bbox, block_type, content, content_type.

    Regions without a tag are empty, but the only region of a request takes an untagged reply whole.
    """
    made = answered.withColumn("parts_", reply_parts(F.coalesce("reply", F.lit(""))))
    made = made.select(*[c for c in made.columns if c != "regions"], F.size("regions").alias("n_"), F.inline("regions"))
    content = F.coalesce(F.element_at("parts_", F.col("region_num")), F.lit(""))
    content = F.when((content == "") & (F.col("n_") == 1), strip(F.coalesce("reply", F.lit("")))).otherwise(content)
    return made.withColumns({"content": content, "content_type": content_type(F.col("block_type"))}).drop("parts_", "n_")


def recognized_blocks(answered: DataFrame) -> DataFrame:
    """Processed blocks of answered requests; failed ones give a marked block for each region. Boxes are scaled back."""
    failed = F.col("error").isNotNull()
    rows = parse_replies(answered)
    return rows.select(
        *PAGE, "request_id", "region_num", "block_type", unscale(F.col("bbox"), F.col("downsample_ratio")).alias("bbox"),
        F.when(failed, F.concat(F.lit("[OCR_FAILED: page "), F.col("page_number").cast("string"), F.lit("]"))).otherwise(F.col("content")).alias("content"),
        F.when(failed, "text").otherwise(F.col("content_type")).alias("content_type"), F.when(failed, "error").otherwise("vlm").alias("source"),
    )


def counters(answered: DataFrame, *keys: str) -> DataFrame:
    """Calls that were answered, and the errors of the others in order of page and request."""
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page_number", "request_id", "error"))))
    made = answered.groupBy(*keys).agg(F.sum(F.col("error").isNull().cast("long")).alias("api_calls"), errors.alias("e"))
    return made.select(*keys, "api_calls", F.transform("e", lambda e: F.concat(F.lit("page "), e["page_number"].cast("string"), F.lit(": "), e["error"])).alias("errors"))


def first_errors(answered: DataFrame, *keys: str, most: int = 5) -> DataFrame:
    """The first errors of each group in order of page and request, as a report shows them; only `most` are gathered."""
    order = Window.partitionBy(*keys).orderBy("page_number", "request_id", "doc_id")
    rows = answered.filter(F.col("error").isNotNull()).withColumn("k_", F.row_number().over(order)).filter(F.col("k_") <= most)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k_", "page_number", "error"))).alias("e"))
    return listed.select(*keys, F.transform("e", lambda e: F.concat(F.lit("page "), e["page_number"].cast("string"), F.lit(": "), e["error"])).alias("errors"))


def validate(rows: DataFrame) -> DataFrame:
    """rows (block_type, bbox, content) with validation_warning and validation_passed: not empty, one warning at most."""
    empty = strip(F.col("content")) == ""
    size = area(F.col("bbox"))
    density = F.length("content") / (size / F.lit(1000.0))
    lower = F.lower("content")
    warnings = F.array_compact(F.array(
        F.when(empty, F.lit("empty output")),
        F.when((size > 0) & (density > 50), F.concat(F.lit("output too long for area (density="), decimals(density, 1), F.lit(")"))),
        F.when((F.col("block_type") == "table") & ~F.contains("content", F.lit("|")) & ~F.contains(lower, F.lit("<table")), F.lit("table output missing pipe or table tag")),
        F.when((F.col("block_type") == "formula") & ~F.contains("content", F.lit("$")) & ~F.contains("content", F.lit("\\")), F.lit("formula output missing LaTeX syntax")),
    ))
    return rows.withColumns({"validation_warning": F.array_join(warnings, "; "), "validation_passed": ~empty & (F.size(warnings) <= 1)})
