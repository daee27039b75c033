"""Run the analysis with spark-submit or ``python -m parecer``.

    python -m parecer --csv IN --tables TABLES      turn CSV files into Parquet tables, once
    python -m parecer --tables TABLES --out OUT     run the steps on them
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from parecer.plans.steps import STEPS, run_steps
from parecer.session import apply_settings
from parecer.sources.tables import read_parquet_tables, read_tables, write_tables


def main() -> None:
    args = argparse.ArgumentParser(prog="parecer", description=__doc__)
    args.add_argument("--csv", help="folder with one CSV file or folder per table; a review file, which "
                      "holds free text, is read by one task, so large ones should come in parts")
    args.add_argument("--tables", required=True, help="folder of the Parquet tables")
    args.add_argument("--out", help="folder for the results")
    args.add_argument("--steps", nargs="*", choices=list(STEPS), help="steps to run; all if unset")
    chosen = args.parse_args()

    spark = SparkSession.builder.appName("parecer").getOrCreate()
    if chosen.csv:
        apply_settings(spark, chosen.csv)
        write_tables(read_tables(spark, chosen.csv), chosen.tables)
    if chosen.out:
        apply_settings(spark, chosen.tables)
        tables = read_parquet_tables(spark, chosen.tables)
        for name, path in run_steps(tables, chosen.out, chosen.steps).items():
            print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
