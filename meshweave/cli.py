"""Command line: `python -m meshweave.cli convert IN FORMAT [-o OUT] [-i FORMAT] [-q] [key=value ...]` and `info FILE ...`."""

from __future__ import annotations

import argparse
import glob
import os
import re
import sys

from pyspark.sql import SparkSession

from .plans.convert import convert, info

_PLACE = re.compile(r"\{RANK(?::(\d+))?\}")


def expand(name: str) -> list[str]:
    """Files that a name with {RANK} or {RANK:N} (N digits) stands for, by rank."""
    if not _PLACE.search(name):
        return [name]
    pattern = _PLACE.sub(lambda m: "[0-9]" * int(m[1]) if m[1] else "*", name)
    parts = _PLACE.split(name)
    number = re.compile("".join(re.escape(x) if k % 2 == 0 else (rf"(\d{{{x}}})" if x else r"(\d+)") for k, x in enumerate(parts)) + "$")
    return sorted((f for f in glob.glob(pattern) if number.match(f)), key=lambda f: int(number.match(f)[1]))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meshweave")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("format", help="vtu, vtp, vti, vtr, vts or any")
    c.add_argument("-o", "--output")
    c.add_argument("-i", "--input-format", help="ignored unless the extension says nothing")
    c.add_argument("-q", "--quiet", action="store_true")
    i = commands.add_parser("info")
    i.add_argument("files", nargs="+")
    said, rest = parser.parse_known_args(args)
    if wrong := [x for x in rest if "=" not in x or x.startswith("-")]:
        parser.error(f"unknown: {' '.join(wrong)}")
    spark = spark or SparkSession.builder.appName("meshweave").getOrCreate()
    if said.command == "convert":
        options = dict(x.split("=", 1) for x in rest)
        if options.get("compressor") == "none":
            options["compressor"] = None
        for source in expand(said.source):
            target = said.output or f"{os.path.splitext(source)[0]}_converted"
            written = convert(spark, source, target if os.path.splitext(target)[1] else f"{target}.{said.format}", said.format, **options)
            if not said.quiet:
                print(written)
        return 0
    for file in said.files:
        grid, fields = info(spark, file)
        print(file)
        grid.select("step", "piece", "kind", "n_points", "n_cells").show(truncate=False)
        fields.select("step", "piece", "assoc", "name", "precision", "layout").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
