from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import selection, vectors
from pairloom.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["pairloom.llm", "zstandard", "xxhash", "corpus_pipeline"])
def test_entry_keeps_the_core_when_an_import_fails(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_ann_finds_most_and_takes_empty_tables(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=16)).tolist()) for i in range(1000)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 20 = 3")
    exact = {(r.q_id, r.k_id) for r in vectors.top_k(q, df, 5, "id", "id", "v").collect()}
    near = {(r.q_id, r.k_id) for r in vectors.ann_top_k(q, df, 5, "id", "id", "v", lists=32, probes=6).collect()}
    assert len(exact & near) >= 0.95 * len(exact)
    none = df.where("id < 0")
    assert vectors.ann_top_k(none, df, 5, "id", "id", "v").count() == 0 and vectors.ann_top_k(q, none, 5, "id", "id", "v").count() == 0


def test_gelu():
    from math import erf

    x = np.linspace(-6, 6, 101)
    assert np.allclose(vectors.gelu(x), [0.5 * v * (1 + erf(v / 2**0.5)) for v in x], atol=1e-6)


def test_split_sizes_and_zip(spark):
    df = spark.range(11).toDF("id")
    sizes = {r.split: r["count"] for r in selection.exact_split(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 8, "test": 3}
    z = selection.positional_zip(df, spark.range(100, 105).toDF("id"), "id", "id").collect()
    assert sorted((r.position, r.left.id, r.right.id) for r in z) == [(i, i, 100 + i) for i in range(5)]
    assert selection.head(df, None, "id").count() == 11 and selection.row_slice(df, 2, 4, "id").count() == 2


def test_refreshing_table(spark):
    made = []

    def make(step):
        made.append(step)
        return spark.range(1).select(F.lit(step).alias("step"))

    t = selection.RefreshingTable(make, 3)
    assert [t.at(s).first().step for s in range(7)] == [0, 0, 0, 3, 3, 3, 6] and made == [0, 3, 6]


def test_store_adds_a_function_once_and_returns_what_it_refuses(spark, tmp_path):
    store = files.VectorStore(spark, f"file://{tmp_path}/store", 2)
    rows = [("p", "f", "g", "x" * 70_000, [1.0, 0.0]), ("p", "f", "h", "y", [0.0, 1.0]), ("p", "f", "i", "z", [1.0])]
    df = spark.createDataFrame(rows, "project_name string, file_name string, function_name string, function_code string, embedding array<double>")
    assert [r.function_name for r in store.insert(df).collect()] == ["i"]
    store.insert(df)
    assert store.count() == 2
    q = spark.createDataFrame([(1, [0.9, 0.1])], "q_id long, embedding array<double>")
    assert store.search(q, 1).first().function_name == store.search(q, 1, lists=2, probes=2).first().function_name == "g"


def test_lenient_listings_and_two_levels(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.s").write_bytes(b"ok \xff\xfe end")
    assert files.read_listings(spark, str(tmp_path), errors="ignore").first().content == "ok  end"
    doc = '{"metadata": {"source_file": "s"}, "functions": [{"function_id": 1, "function_name": "f", "signature": "", "body": "b"}]}'
    (tmp_path / "a" / "d.json").write_text(doc)
    (tmp_path / "a" / "deep").mkdir()
    (tmp_path / "a" / "deep" / "e.json").write_text(doc)
    (tmp_path / "f.json").write_text(doc)
    got = files.read_project_documents(spark, str(tmp_path)).collect()
    assert [(r.project, len(r.functions)) for r in got] == [("a", 1)]


def test_a_template_holds_the_code_once(spark):
    from pairloom.functions import text

    with pytest.raises(ValueError, match="exactly once"):
        text.prompt(F.lit("x"), "c", "no place")


def test_command_line(spark, tmp_path, sf_dir):
    from pairloom import __main__ as cli

    cli.main(["head_rows", "--data", sf_dir, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
