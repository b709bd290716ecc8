"""Parsers as table functions of SQL: ``register(spark)``, then for instance

    SELECT * FROM listing_functions(TABLE(lines) PARTITION BY path ORDER BY n)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions.parsing import LISTING_HEAD


class ListingFunctions:
    """Functions of disassembly listings from a table of their lines.

    ``listing_functions(TABLE(t) PARTITION BY key ORDER BY position [, line => 'column'])``:
    a partition is a listing; its rows come in order and one function is held at a time.
    Returns listing (the first column of t as text), function_id, name, start_addr, body.
    Null lines are empty; what stands before the first function is dropped. A single
    listing is one task's work here; ``sources.files.functions_of_lines`` spreads it.
    """

    def __init__(self) -> None:
        self.head = re.compile(LISTING_HEAD)
        self.count, self.first, self.listing, self.body = 0, None, None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument, line: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("listing_functions takes TABLE(...) as its first argument")
        column = line.value if line is not None else "line"
        if column not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {column!r}")
        schema = StructType().add("listing", StringType()).add("function_id", IntegerType()).add("name", StringType()).add("start_addr", StringType()).add("body", StringType())
        return AnalyzeResult(schema=schema)

    def _done(self) -> Iterator[tuple]:
        if self.first:
            yield self.listing, self.count, self.first[2], self.first[1], "\n".join(self.body).rstrip()

    def eval(self, row: Row, line: str | None = None) -> Iterator[tuple]:
        text = row[line or "line"] or ""
        found = self.head.match(text)
        if found:
            yield from self._done()
            self.count, self.first, self.body = self.count + 1, found, []
            self.listing = None if row[0] is None else str(row[0])
        elif self.first:
            self.body.append(text)

    def terminate(self) -> Iterator[tuple]:
        yield from self._done()


def register(spark: SparkSession) -> None:
    """Makes the table functions, and object files as a format, known to the session."""
    from .sources.object_files import ObjectFiles

    spark.udtf.register("listing_functions", udtf(ListingFunctions))
    spark.dataSource.register(ObjectFiles)
