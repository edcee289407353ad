"""Command line: ``analyze`` plain texts, ``scan`` them for patterns, or ``pages`` for page JSON."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pagegrain.operators import blocks, patterns, spacing
from pagegrain.params import PROFILES, LayoutParams
from pagegrain.plans import report, summary
from pagegrain.sources import adapters, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagegrain")
    p.add_argument("command", choices=("analyze", "scan", "pages", "report"))
    p.add_argument("source", help="Parquet of documents (doc_id, text), or a folder of page JSON for pages")
    p.add_argument("--out", required=True, help="folder for the tables")
    p.add_argument("--base", default="documents", help="first part of the tables' names")
    p.add_argument("--profile", choices=sorted(PROFILES))
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a parameter, such as y_tolerance=2.5")
    p.add_argument("--pages", help="pages to keep, such as 2-5")
    return p


def parameters(profile: str | None, given: Sequence[str]) -> LayoutParams:
    params = LayoutParams.from_env()
    if profile:
        params = params.with_profile(profile)
    values = dict(x.split("=", 1) for x in given)
    return LayoutParams(**{**params.__dict__, **{k: float(v) for k, v in values.items()}})


def tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    params = parameters(args.profile, args.set)
    if args.command == "pages":
        records = adapters.page_records(adapters.read_pages(spark, args.source))
        adapters.require_pages(records)
        return {"items": records}
    lines = adapters.layout_lines(spark.read.parquet(args.source))
    if args.pages:
        low, _, high = args.pages.partition("-")
        lines = adapters.page_range(lines, int(low), int(high or low))
    lines = spacing.with_gaps(lines)
    if args.command == "report":
        return {"report": report.report_lines(lines)}
    if args.command == "scan":
        return {"matches": patterns.scan(lines), "statistics": patterns.statistics(patterns.scan(lines), patterns.catalogue(spark))}
    # every table below starts from the lines, so they are written once and read again
    lines = spark.read.parquet(sinks.write_stage(lines, args.out, args.base, "lines"))
    found = summary.analyze_spacing(lines, params)
    edges = summary.analyze_boundaries(lines, params)
    body = blocks.with_block_gaps(blocks.blocks(blocks.numbered_lines(lines, found["rules"])))
    return {"rules": found["rules"], "paragraphs": found["paragraphs"], "blocks": body, "boundaries": edges["boundaries"], "summary": summary.document_summary(lines.drop("gap_before", "gap_after"), params)}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagegrain").getOrCreate()
    paths = {name: sinks.write_stage(df, args.out, args.base, name) for name, df in tables(spark, args).items()}
    return ({"lines": f"{args.out.rstrip('/')}/{args.base}_lines"} if args.command == "analyze" else {}) | paths


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}: {path}")
