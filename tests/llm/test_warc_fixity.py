from __future__ import annotations

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import warc_fixity as w
from pairloom.llm.common import Scratch


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(i, f"http://h{i % 5}.org/{i}", "é" * (i % 400) + str(i * 7919)) for i in range(300)] + [(None, None, None), (3, "http://h3.org/3", "again"), (3, "http://h3.org/3", "again")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, shard string, length int")
    folder = f"file://{tmp_path}/a"
    tmp = Scratch(spark, "test")
    index = tmp.save(w.write_archive(df, folder, shard_bytes=9_000), "index")
    return rows, tmp, index, tmp_path


def trees(tmp, index, path, **options):
    out = []
    for r in "ab":
        leaf = tmp.save(w.leaves(index, f"file://{path}/{r}"), f"leaves-{r}")
        out.append(w.Tree(leaf, tmp, f"tree-{r}", **options))
    return out


def test_shards_are_warc_and_the_index_is_right(archive):
    rows, _, index, path = archive
    got = index.collect()
    assert len(got) == len(rows) and len({r.shard for r in got}) > 3
    for r in got:
        raw = (path / "a" / w.shard_name(r.shard)).read_bytes()
        text = gzip.decompress(raw[r.offset : r.offset + r.length])
        head, body = text.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and f"Content-Length: {len(body) - 4}".encode() in head
    for shard in {r.shard for r in got}:
        assert (path / "a" / w.shard_name(shard)).stat().st_size == sum(r.length for r in got if r.shard == shard)
    assert not list(path.glob("a/.*"))


@pytest.mark.parametrize(("range_bytes", "fanout"), [(300, 2), (2_000, 3), (1 << 16, 16)])
def test_audit_finds_exactly_the_damage(archive, range_bytes, fanout):
    _, tmp, index, path = archive
    flipped = index.withColumn("flip", F.col("seq") % 17 == 4)
    tmp.save(w.copy_archive(flipped, f"file://{path}/a", f"file://{path}/b"), "copied")
    got = {(r.shard, r.seq) for r in w.audit(*trees(tmp, index, path, range_bytes=range_bytes, fanout=fanout), tmp).collect()}
    assert got == {(r.shard, r.seq) for r in index.collect() if r.seq % 17 == 4}


def test_equal_replicas_have_equal_roots(archive):
    _, tmp, index, path = archive
    tmp.save(w.copy_archive(index.withColumn("flip", F.lit(False)), f"file://{path}/a", f"file://{path}/b"), "copied")
    a, b = trees(tmp, index, path)
    assert a.root() == b.root() and w.audit(a, b, tmp).count() == 0


def test_only_differing_branches_are_followed(archive):
    _, tmp, index, path = archive
    one = index.orderBy("shard", "seq").first()
    flip = (F.col("shard") == one.shard) & (F.col("seq") == one.seq)
    tmp.save(w.copy_archive(index.withColumn("flip", flip), f"file://{path}/a", f"file://{path}/b"), "copied")
    a, b = trees(tmp, index, path, range_bytes=500, fanout=2)
    assert w.audit(a, b, tmp).count() == 1
    spark = index.sparkSession
    assert all(spark.read.parquet(tmp.path(f"bad-{k}")).count() == 1 for k in range(len(a.levels)))


def test_missing_and_short_files(archive):
    _, tmp, index, path = archive
    tmp.save(w.copy_archive(index.withColumn("flip", F.lit(None).cast("boolean")), f"file://{path}/a", f"file://{path}/b"), "copied")
    got = index.collect()
    shards = sorted({r.shard for r in got})
    (path / "b" / w.shard_name(shards[0])).unlink()
    short = path / "b" / w.shard_name(shards[1])
    size = short.stat().st_size
    short.write_bytes(short.read_bytes()[:-5])
    found = w.audit(*trees(tmp, index, path), tmp).collect()
    expected = {(r.shard, r.seq) for r in got if r.shard == shards[0] or (r.shard == shards[1] and r.offset + r.length == size)}
    assert {(r.shard, r.seq) for r in found} == expected and all(r.sha256_b is None for r in found)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    tmp = Scratch(spark, "test")
    index = tmp.save(w.write_archive(df, f"file://{tmp_path}/a"), "index")
    assert index.count() == 0
    assert w.audit(*trees(tmp, index, tmp_path), tmp).count() == 0


def test_query(spark, sf_dir):
    got = w.op4_warc_fixity(spark, sf_dir).collect()
    ids = [r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(r.page_id for r in got) == sorted(ids)
    assert {r.page_id for r in got if r.status != "ok"} == {i for i in ids if zlib.crc32(str(i).encode()) % 211 == 5}


def test_added_bytes_are_found(spark, tmp_path):
    tmp = Scratch(spark, "t")
    rows = [(i, f"http://x/{i}", "page " * (i + 1)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = tmp.save(w.write_archive(pages, a, shard_bytes=8000), "index")
    tmp.save(w.copy_archive(index.withColumn("flip", F.lit(False)), a, b), "copied")
    shard = index.selectExpr("max(shard) as s").first().s
    with open(f"{tmp_path}/b/{w.shard_name(shard)}", "ab") as f:
        f.write(w.record("http://added", "a record more"))
    la, lb = (tmp.save(w.leaves(index, r), f"l{r[-1]}") for r in (a, b))
    audited = w.audit(w.Tree(la, tmp, "ta"), w.Tree(lb, tmp, "tb"), tmp)
    found = audited.collect()
    assert [(r.sha256_a, r.sha256_b is None) for r in found] == [(None, False)] and la.count() == 60
    judged = w.verdicts(la, audited).collect()
    assert len(judged) == 61 and [(r.page_id, r.shard, r.sha256) for r in judged if r.status != "ok"] == [(None, shard, found[0].sha256_b)]
    assert [r.status for r in judged if r.status != "ok"] == ["added"]


def test_repeated_rows_are_dealt_over_shards(spark, tmp_path):
    tmp = Scratch(spark, "t")
    pages = spark.range(200).selectExpr("1L as page_id", "'u' as url", "repeat('x', 500) as html")
    index = tmp.save(w.write_archive(pages, f"file://{tmp_path}/a", shard_bytes=16_000), "index")
    sizes = [r["count"] for r in index.groupBy("shard").count().collect()]
    assert sum(sizes) == 200 and len(sizes) >= 8 and max(sizes) <= 60
