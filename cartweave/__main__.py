"""Command line: ``python -m cartweave --from pbf --input in.pbf --filter keep.osmfilter --to json --output out.json``."""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from cartweave.errors import EngineError
from cartweave.operators.filters import compile_filter
from cartweave.operators.sinks import write
from cartweave.operators.workspace import fresh_path
from cartweave.sources.registry import read_osm, resolve

log = logging.getLogger("cartweave")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cartweave", description="Converts OpenStreetMap data between formats, through filters.")
    p.add_argument("--filter", action="append", default=[], metavar="FILE", help="a filter file; may be given more than once, applied in order")
    p.add_argument("--from", dest="source", metavar="FORMAT", help="json, opl, xml or pbf; else by the name of the input")
    p.add_argument("--to", metavar="FORMAT", help="json, opl, xml or overpass; else by the name of the output")
    p.add_argument("--input", metavar="FILE", help="else standard input")
    p.add_argument("--output", metavar="FILE", help="else standard output")
    return p.parse_args(argv)


def convert(spark: SparkSession, source: str, target: str, filters: list[str], source_format: str, target_format: str) -> None:
    compiled = [compile_filter(Path(f).read_text()) for f in filters]  # a mistake in a filter shows before anything is read
    elements, meta = read_osm(spark, source, source_format)
    for f in compiled:
        elements = f(elements)
    write(elements, target, target_format, meta)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=os.environ.get("CARTWEAVE_LOG", "WARNING").upper())
    args = arguments(argv)
    try:
        source_format, target_format = resolve(args.source, args.input), resolve(args.to, args.output, output=True)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    log.info("from %s to %s", source_format, target_format)
    spark = SparkSession.builder.appName("cartweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    # Standard input and output go through the folder that executors see too.
    own = fresh_path(spark, "convert")
    source, target = args.input or f"{own}/in.{source_format}", args.output or f"{own}/out.{target_format}"
    system, where = fs.FileSystem.from_uri(own) if None in (args.input, args.output) else (None, None)
    try:
        if args.input is None:
            system.create_dir(where, recursive=True)
            with system.open_output_stream(f"{where}/in.{source_format}") as f:
                shutil.copyfileobj(sys.stdin.buffer, f)
        convert(spark, source, target, args.filter, source_format, target_format)
        if args.output is None:
            with system.open_input_stream(f"{where}/out.{target_format}") as f:
                shutil.copyfileobj(f, sys.stdout.buffer)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    finally:
        if system is not None and system.get_file_info(where).type != fs.FileType.NotFound:
            system.delete_dir(where)
    return 0


if __name__ == "__main__":
    sys.exit(main())
