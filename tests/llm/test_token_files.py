from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import token_files


def written(docs, width=2):
    sink = io.BytesIO()
    w = token_files.Writer(sink, width)
    for d, ids in docs:
        w.add(d, np.array(ids, "<u4"))
    w.close()
    return sink.getvalue()


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**62), 2**62), st.lists(st.integers(0, 65535), max_size=30)), max_size=8), st.sampled_from([2, 4]))
def test_round_trip(docs, width):
    r = token_files.Reader(io.BytesIO(written(docs, width)))
    assert r.doc_ids == [d for d, _ in docs]
    assert [r.read(i).tolist() for i in range(len(r))] == [x for _, x in docs]


def test_only_what_is_asked_for_is_read():
    rng = np.random.default_rng(1)
    f = Counting(written([(i, rng.integers(0, 60000, 5000)) for i in range(50)]))
    r = token_files.Reader(f)
    assert len(r.find(33)) == 1 and f.taken < len(f.getvalue()) / 20


def test_plain_zstandard_reads_the_frames():
    raw = written([(1, [1, 2]), (2, [3])])
    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(out, "<u2").tolist() == [1, 2, 3]


def test_damage_is_noticed():
    raw = bytearray(written([(1, list(range(200)))]))
    raw[12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(io.BytesIO(bytes(raw))).read(0)
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(b"x" * 40))


def test_files_of_a_table(spark, tmp_path):
    rows = [(5, "five words are in here"), (2, None), (9, ""), (2, "two"), (None, "none"), (7, "x" * 30_000), (5, "five words are in here")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_tokens int, name string")
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write_files(df, folder, files=3).cache()
    got = token_files.read_files(manifest, folder).orderBy("start").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == expected
    assert not list(tmp_path.glob("out/.*tmp"))
    empty = token_files.write_files(df.where("doc_id = 0"), f"file://{tmp_path}/none")
    assert token_files.read_files(empty, f"file://{tmp_path}/none").count() == 0


def test_query(spark, sf_dir):
    got = token_files.op7_token_files(spark, sf_dir).orderBy("doc_id").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, d in zip(got, spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array([*t.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
