"""python -m foliate.cli pdf|files|estimate|classify|validate|convert FOLDER [--out DIR] | config show|validate|init [PATH] | doctor | version

pdf converts the PDF files of a folder, to a table or, with --files, to a document.md for each; the others take tables of pages
(estimate, classify, validate) or recognised blocks (convert).
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

VERSION = "0.1.0"


def doctor() -> dict[str, str]:
    """What is installed, and in which version."""
    found = {"python": sys.version.split()[0], "foliate": VERSION}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "yaml"):
        spec = importlib.util.find_spec(name)
        found[name] = getattr(__import__(name), "__version__", "there") if spec else "missing"
    return found


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliate")
    parser.add_argument("verb", choices=("pdf", "estimate", "classify", "validate", "convert", "config", "doctor", "version"))
    parser.add_argument("target", nargs="?", default="")
    parser.add_argument("path", nargs="?", default="./config.yaml")
    parser.add_argument("--config", default="./config.yaml")
    parser.add_argument("--out")
    parser.add_argument("--files", action="store_true")
    parser.add_argument("--recursive", action="store_true")
    given = parser.parse_args(args)

    from foliate import config as C

    if given.verb == "version":
        print(VERSION)
        return 0
    if given.verb == "doctor":
        print(json.dumps(doctor(), indent=2))
        return 0
    if given.verb == "config":
        if given.target == "init":
            C.save(C.DEFAULTS, given.path)
        elif given.target == "validate":
            wrong = C.validate(C.load(given.path))
            print("\n".join(wrong) or "valid")
            return int(bool(wrong))
        else:
            shown = C.load(given.path)
            shown["vlm"]["api_key"] = "***" if shown["vlm"]["api_key"] else ""
            print(json.dumps(shown, indent=2, ensure_ascii=False))
        return 0

    from pyspark.sql import SparkSession

    from foliate.engine import Engine

    spark = SparkSession.builder.appName("foliate").getOrCreate()
    engine = Engine(spark, C.load(given.config))
    if given.verb == "pdf":
        made = engine.convert_files(given.target, given.recursive)
        if given.out and given.files:
            from foliate.sources.sinks import write_files

            print(write_files(made.filter("error is null"), given.out))
            return 0
    else:
        rows = spark.read.parquet(given.target)
        verbs = {"estimate": lambda: engine.estimate(rows, "doc_id"), "classify": lambda: engine.classify(rows), "validate": lambda: engine.validate(rows), "convert": lambda: engine.convert(rows)}
        made = verbs[given.verb]()
    if given.out:
        made.write.mode("overwrite").parquet(given.out)
    else:
        made.show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
