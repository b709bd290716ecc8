from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import includes
from pairloom.operators.scan import running_total
from pairloom.sources import files
from pairloom.sql import register


def test_include_dirs_walk_up(spark):
    paths = ["src/a/x.c", "src/a/include/y.h", "src/include/z.h", "include/w.h", "lib/deep/inc/v.h", "main.c", "src/a/inc/u.h"]
    df = spark.createDataFrame([("p", x) for x in paths] + [("q", "src/a/x.c"), ("p", None), (None, "x.c"), ("p", "main.c")], "project string, path string")
    got = {(r.project, r.path): r.dirs for r in includes.include_dirs(df).collect()}
    assert got["p", "src/a/x.c"] == ["src/a/include", "src/a/inc", "src/include", "include", "src", "lib"]
    assert got["p", "main.c"] == ["include", "src", "lib"] and got["q", "src/a/x.c"] == ["src"]
    assert len(got) == len(paths) + 1
    assert includes.include_dirs(df.limit(0)).count() == 0


def test_include_edges(spark):
    text = '#include "y.h"\n # include <w.h>\n// no\n#include "../b/t.h"\n#include "y.h"\n#include <stdio.h>\n'
    rows = [("p", "src/a/x.c", text), ("p", "src/a/include/y.h", '#include "w.h"'), ("p", "include/w.h", None), ("p", "src/b/t.h", ""), ("p", "y.h", "")]
    df = spark.createDataFrame(rows, "project string, path string, content string")
    got = {(r.path, r.name): r.included for r in includes.include_edges(df).collect()}
    assert got == {("src/a/x.c", "y.h"): "src/a/include/y.h", ("src/a/x.c", "w.h"): "include/w.h", ("src/a/x.c", "../b/t.h"): "src/b/t.h", ("src/a/x.c", "stdio.h"): None, ("src/a/include/y.h", "w.h"): "include/w.h"}


@pytest.mark.parametrize(("seed", "hops"), [(0, 1), (1, 2), (2, 4), (3, 8)])
def test_reach_with_cycles(spark, seed, hops):
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    edges |= {(k, k + 1) for k in range(100, 125)} | {(200, 200)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, 1), (2, None)], "a int, b int")
    got = [tuple(r) for r in includes.reach(df, "a", "b", hops).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert includes.reach(df.limit(0), "a", "b").count() == 0


def test_running_totals_over_many_blocks(spark):
    # one group holds nearly all rows; positions have gaps of whole blocks
    rng = random.Random(3)
    at = sorted(rng.sample(range(60_000_000), 3000))
    rows = [("hot", n, rng.choice([0, 1, 1, -2, None])) for n in at] + [("cold", 5, 1), (None, 9, 4), (None, 4096, 5)]
    rng.shuffle(rows)
    want, held = {}, {}
    for g, n, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        held[g] = held.get(g, 0) + (x or 0)
        want[g, n] = held[g]
    df = spark.createDataFrame(rows, "g string, n long, x int").withColumnsRenamed({"g": "grp"})
    got = {(r.grp, r.n): r.total for r in running_total(df, "grp", "n", F.col("x")).collect()}
    assert got == want


def test_a_long_listing_is_many_tasks(spark, tmp_path):
    lines, want = ["x.o:  file format elf64", ""], []
    for k in range(400):
        body = [f"  {k}: op{j}" for j in range(k % 60)]
        lines += [f"{k:016x} <f{k}>:", *body, ""]
        want.append((k + 1, f"f{k}", f"{k:016x}", "\n".join(body)))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.s").write_text("\n".join(lines))
    (tmp_path / "two.s").write_text("0 <g>:\r\n  ret\r\n")
    (tmp_path / "no.txt").write_text("1 <no>:")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = files.functions_of_lines(rows).collect()
        per_row = files.listing_rows(files.read_listings(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = sorted((r.function_id, r.name, r.start_addr, r.body) for r in got if r.path.endswith("one.s"))
    assert one == want and [(r.name, r.body) for r in got if r.path.endswith("two.s")] == [("g", "  ret")]
    assert sorted((r.path, r.function_id, r.body) for r in got) == sorted((r.path, r.function_id, r.body) for r in per_row)


def test_listings_in_sql(spark):
    register(spark)
    rows = [("a", 3, "  ret"), ("a", 2, "10 <f>:"), ("a", 1, "before"), ("a", 5, "20 <g>:"), ("a", 4, None), ("b", 1, "0 <f>:"), (None, 1, "0 <h>:"), (None, 2, "  x")]
    spark.createDataFrame(rows, "path string, n int, text string").createOrReplaceTempView("asm_lines")
    got = spark.sql("SELECT * FROM listing_functions(TABLE(asm_lines) PARTITION BY path ORDER BY n, line => 'text')").collect()
    assert {tuple(r) for r in got} == {("a", 1, "f", "10", "  ret"), ("a", 2, "g", "20", ""), ("b", 1, "f", "0", ""), (None, 1, "h", "0", "  x")}
    for bad in ("TABLE(asm_lines) PARTITION BY path", "'no table'"):
        with pytest.raises(Exception, match="listing_functions|no column"):
            spark.sql(f"SELECT * FROM listing_functions({bad})").collect()
    spark.catalog.dropTempView("asm_lines")
