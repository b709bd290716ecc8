"""Runs a registered query: python -m pairloom QUERY --data FOLDER --out FOLDER."""

from __future__ import annotations

import argparse

from .plans import registry
from .session import build_session


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pairloom", description="Run a query over the tables of a folder.")
    p.add_argument("query", choices=sorted(registry.QUERIES))
    p.add_argument("--data", required=True, help="folder of the Parquet tables")
    p.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    p.add_argument("--master", help="Spark master, if the session is not made by spark-submit")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a session setting")
    a = p.parse_args(arguments)
    spark = build_session(master=a.master, **dict(c.split("=", 1) for c in a.conf))
    df = registry.QUERIES[a.query](spark, a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
