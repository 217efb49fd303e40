"""Command line: validate (artificial gaps) and fill over a CSV of one or more sites."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .errors import TidemarkError
from .operators import fill, timeaxis
from .plans import accounting, config
from .plans.validation import validate, wide_predictions
from .sources import tables


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "fill"):
        c = commands.add_parser(name)
        c.add_argument("data", help="CSV with a header")
        c.add_argument("--schema", required=True, help="columns and types, e.g. 'site_id string, TIMESTAMP_START string, LE double'")
        c.add_argument("--config", required=True, help="JSON or YAML settings")
        c.add_argument("--timestamp", default="TIMESTAMP_START")
        c.add_argument("--format", help="pattern of the stamps, e.g. yyyyMMddHHmm")
        c.add_argument("--target", action="append", required=True)
        c.add_argument("--qc", action="append", default=[], metavar="TARGET=COLUMN")
        c.add_argument("--out", required=True, help="folder for the results; must not hold any")
        c.add_argument("--on-duplicates", default="error", choices=["error", "keep_first", "keep_last"])
        c.add_argument("--min-rows", type=int, default=2, help="fewest rows to fit on")
        if name == "validate":
            c.add_argument("--check-leakage", action="store_true")
            c.add_argument("--energy-balance", metavar="H,LE", help="targets whose closure is compared")
            c.add_argument("--on-incomplete", default="missing", choices=["missing", "raise"])
            c.add_argument("--on-shortfall", default="warn", choices=["warn", "raise", "ignore"])
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    """0 when done, 1 with one line on standard error where input or settings are refused."""
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        settings = config.load(args.config)
        df = tables.read_csv(spark, args.data, args.schema, args.timestamp, args.format)
        df, _ = timeaxis.prepare(df, "ts", settings.frequency, args.on_duplicates, sequence=args.timestamp)
        qc = dict(q.split("=", 1) for q in args.qc)
        if args.command == "validate":
            steps = timeaxis.step_of(df, settings.frequency)
            pair = tuple(args.energy_balance.split(",")) if args.energy_balance else None
            found = validate(df, settings, args.target, qc, steps=steps, check_leakage=args.check_leakage, energy_pair=pair, on_incomplete=args.on_incomplete, on_shortfall=args.on_shortfall, min_rows=args.min_rows)
            for name, result in found.items():
                more = {"bias_spread": result.spread, "energy_balance": result.energy_balance}
                made = {"metrics": result.scores, "predictions": result.predictions.drop("observed"), "gaps": result.gaps, "unscored": result.unscored} | {k: v for k, v in more.items() if v is not None}
                tables.write_results(made, f"{args.out}/{name}", result.manifest())
            tables.write_results({"wide_predictions": wide_predictions(found)}, args.out)
        else:
            for name in args.target:
                accounting.write_fill(fill.GapFiller(settings).fit(df, name, qc.get(name), args.min_rows), df, f"{args.out}/{name}")
    except TidemarkError as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
