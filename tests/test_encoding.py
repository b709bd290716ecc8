from __future__ import annotations

import numpy as np
import pytest

from pairloom.operators import encoding
from pairloom.operators.encoding import HashedWords, Loader, encode, model_batches


def counting(folder, refused=()):
    """A loader whose models leave a file for each load, and a line for each batch."""

    def load():
        import os
        import uuid

        name = f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}"

        class Counting(HashedWords):
            def encode(self, batch):
                with open(name, "a") as f:
                    f.write(" ".join(str(len(b)) for b in batch) + "\n")
                return super().encode(batch)

        open(name, "w").close()
        return Counting(8, frozenset(refused))

    return Loader(f"counting-{folder}", load, 8)


def test_one_load_a_worker_and_input_order(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(12).sortWithinPartitions("id")
    order = [r.id for r in df.collect()]
    for _ in range(2):
        got = encode(df, "text", counting(tmp_path), max_tokens=30, batch_tokens=200, batch_rows=16).collect()
        assert [r.id for r in got] == order
    want = HashedWords(8)
    for r in got:
        words = dict(rows)[r.id].split()
        assert (r.n_tokens, r.truncated, r.encode_error) == (min(30, len(words)), len(words) > 30, None)
        assert np.allclose(r.embedding, want.encode([words[:30]])[0], atol=1e-6)
    loads = [f.name.split("-")[1] for f in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) <= 12  # no process has loaded twice, in 24 tasks
    for f in tmp_path.iterdir():
        for line in f.read_text().splitlines():
            sizes = [int(x) for x in line.split(" ") if x]
            assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 16 and (len(sizes) == 1 or len(sizes) * sizes[0] <= 200)


def test_a_failed_batch_is_its_rows_error(spark, tmp_path):
    rows = [(0, "a b c"), (1, "boom x y z"), (2, None), (3, ""), (4, "a"), (5, "q r s t")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: r for r in encode(df, "text", counting(tmp_path, ["boom"]), batch_rows=2).collect()}
    assert {i for i, r in got.items() if r.encode_error} == {1, 5}  # the two longest are one batch
    assert got[1].encode_error == "ValueError: cannot encode 'boom'" and got[1].embedding is None and got[1].n_tokens == 4
    assert got[2].embedding is None and got[2].encode_error is None and got[2].n_tokens is None
    assert got[3].embedding == [0.0] * 8 and got[4].embedding is not None
    assert encoding.dense(encode(df, "text", counting(tmp_path, ["boom"]), batch_rows=2)).columns == ["id", "text", "embedding"]
    wrong = Loader("wrong-dim", lambda: HashedWords(4), 8)
    assert all("shape" in r.encode_error for r in encode(df.where("text = 'a'"), "text", wrong).collect())
    assert encode(df.limit(0), "text", wrong).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        encode(df.withColumnRenamed("id", "n_tokens"), "text", wrong)


def test_model_batches():
    assert model_batches([3, 9, 1, 9, 0], 18, 10) == [[1, 3], [0, 2, 4]]
    assert model_batches([100], 5, 10) == [[0]] and model_batches([], 5, 10) == []
    assert sorted(i for b in model_batches(list(range(40)), 64, 4) for i in b) == list(range(40))


def test_profile_asks_for_accelerators(spark):
    p = encoding.accelerator_profile(8, "16g", 2)
    assert p.taskResources["gpu"].amount == 1 and p.taskResources["cpus"].amount == 4 and p.executorResources["gpu"].amount == 2


def test_tokens_are_held_for_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(encoding, "ROWS", 20)

    def load():
        class Watched(HashedWords):
            held = 0

            def tokens(self, text):
                self.held += 1
                return super().tokens(text)

            def encode(self, batch):
                if self.held > 20:
                    raise ValueError("too many texts at a time")
                self.held -= len(batch)
                return super().encode(batch)

        return Watched(8)

    rows = [(i, None if i % 9 == 0 else "a b c " * (i % 5)) for i in range(130)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = encode(df, "text", Loader("watched", load, 8), max_tokens=6).collect()
    assert [r.id for r in got] == list(range(130)) and not any(r.encode_error for r in got)
    assert [(r.n_tokens, r.truncated) for r in got] == [(None, None) if t is None else (min(6, len(t.split())), len(t.split()) > 6) for _, t in rows]
