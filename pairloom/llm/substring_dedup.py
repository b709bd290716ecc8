"""Substring dedup with fixed-block anchors.

Any window of ``window`` = 2 b - 1 words holds exactly one whole block of b words of the
grid that cuts its document into non-overlapping blocks. So the reference index holds
only these blocks, every document probes it with all its rolling b-word windows, and a
repeat of ``window`` words or more always has a hit. Hits are extended: the windows that
hold a hit are compared in full, which joins up into the maximal exact repeats of each
document. What is compared are 96 bits: two rolling hashes, of independent word hashes of
64 bits each, over all words of a window. Among 10^13 windows (100 TB of text) less than
0.001 false pairs are to be expected.

Entries travel in columns packed by target partition (6 bytes a probe, the lowest bit of
the hash tells blocks from other windows) rather than as rows, and so do the answers,
packed by group of documents. Within a task's batch
equal hashes of several documents are merged before the shuffle: the documents are hits
already, and one of them speaks for all, so a passage that a third of all documents hold
costs one entry a batch. Texts are dealt out by document once, compressed; the three
passes over them read the same exchange.

Defined results: a null text has no words; a null id ranks above all others, so such a
document is judged against the rest but never removes from them; documents with equal
ids do not remove from each other; repeated rows give repeated results; a text shorter
than the window keeps all its words; an empty table gives an empty result; columns other
than id and text are neither read nor returned. ``docs`` is read once, so any plan will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, split_count

LAST = np.iinfo(np.int64).max
#: words handled at once within a task
BATCH_WORDS = 300_000
U = np.uint64


class Words:
    """Two 64-bit hashes of each word (rows of 2), remembered for at most ``keep`` words of this task."""

    def __init__(self, keep: int = 150_000):
        self.seen: dict[bytes, bytes] = {}
        self.keep = keep

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.keep:
            self.seen.clear()
        seen, h = self.seen, xxhash.xxh3_128_digest
        for w in set(words).difference(seen):
            seen[w] = h(w)
        return np.frombuffer(b"".join(map(seen.__getitem__, words)), np.uint64).reshape(-1, 2)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (one hash each); the runs of a batch may cross documents."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * U(0x9E3779B97F4A7C15) + words[i : n + i]
        out ^= out >> U(29)
    out *= U(0xBF58476D1CE4E5B9)
    return out ^ (out >> U(32))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [z.compress((t.as_py() or "").encode()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("kb"), b.column("key"), b.column("id"), pa.array(packed, pa.binary())], names=["kb", "key", "id", "packed"])


class Batch:
    """Documents of one pass: ids and the hashes of all their words, end to end."""

    def __init__(self) -> None:
        self.keys, self.ids, self.words, self.extra = [], [], [], []
        self.n = 0

    def add(self, key: int, id_: int | None, words: np.ndarray, extra: np.ndarray | None = None) -> None:
        self.keys.append(key)
        self.ids.append(LAST if id_ is None else id_)
        self.words.append(words)
        self.extra.append(extra)
        self.n += len(words)

    def runs(self, width: int, lanes: int = 1) -> tuple[np.ndarray, ...]:
        """(document, position, hash, ...) of all runs of ``width`` words within a document; one hash for each lane."""
        lengths = np.array([len(w) for w in self.words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = np.maximum(lengths - width + 1, 0)
        doc = np.repeat(np.arange(len(lengths)), counts)
        pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        words, at = np.concatenate(self.words), starts[doc] + pos
        return doc, pos, *(rolling(np.ascontiguousarray(words[:, k]), width)[at] for k in range(lanes))


def _filled(batches: Iterator[pa.RecordBatch], least: int, hits: dict[int, np.ndarray] | None = None) -> Iterator[Batch]:
    """Documents of at least ``least`` words (that have hits, if these are given)."""
    z, hasher, held = zstandard.ZstdDecompressor(), Words(), Batch()
    for b in batches:
        for key, id_, packed in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), b.column("packed"), strict=True):
            if hits is not None and key not in hits:
                continue
            words = z.decompress(packed.as_py()).split()
            if len(words) < least:
                continue
            held.add(key, id_, hasher(words), None if hits is None else hits[key])
            if held.n >= BATCH_WORDS:
                yield held
                held = Batch()
    if held.n:
        yield held


def _firsts(*values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, or in several that are sorted together."""
    if not len(values[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in values])))


MESSAGE = pa.schema([("part", pa.int32()), ("kb", pa.int32()), ("blob", pa.binary())])
MESSAGE_DDL = "part int, kb int, blob binary"


def _messages(part: list, kb: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kb, pa.int32()), pa.array(blob, pa.binary())], schema=MESSAGE)


def _settled(keys: np.ndarray, hashes: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Answers (key, hash), one blob for each group of documents: n, keys, counts, hashes. Part is -1: no more to decide."""
    group = keys % groups
    order = np.lexsort((keys, group))
    keys, hashes, group = keys[order], hashes[order], group[order]
    at = np.append(_firsts(group), len(group))
    out_group, out_blob = [], []
    for a, z in zip(at[:-1], at[1:], strict=True):
        k = _firsts(keys[a:z])
        counts = np.diff(np.append(k, z - a)).astype(np.uint32)
        out_group.append(int(group[a]))
        out_blob.append(b"".join([np.uint32(len(k)).tobytes(), keys[a:z][k].tobytes(), counts.tobytes(), hashes[a:z].tobytes()]))
    if out_group:
        yield _messages([-1] * len(out_group), out_group, out_blob)


def _answers_of(blobs: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Key to its sorted distinct hashes."""
    keys, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for blob in blobs:
        raw = blob.as_py()
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        counts = np.frombuffer(raw, np.uint32, n, 4 + 8 * n)
        keys.append(np.repeat(np.frombuffer(raw, np.int64, n, 4), counts))
        hashes.append(np.frombuffer(raw, np.uint64, int(counts.sum()), 4 + 12 * n))
    keys, hashes = np.concatenate(keys), np.concatenate(hashes)
    order = np.lexsort((hashes, keys))
    keys, hashes = keys[order], hashes[order]
    at = np.append(_firsts(keys), len(keys))
    return {int(keys[a]): np.unique(hashes[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)}


def _dealt(hashes: np.ndarray, keys: np.ndarray, ids: np.ndarray | None, parts: int, wide: bool, more: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Entries (sorted by key within a part) as one blob for each part.

    The part comes from the upper bits of the hash. Blob: n, then keys, ids (if given) and counts of
    the n documents, then the hashes, 6 bytes each (8 if wide), then 4 bytes ``more`` each, if given.
    """
    part = ((hashes >> U(16)) % U(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    hashes, keys, part = hashes[order], keys[order], part[order]
    ids = None if ids is None else ids[order]
    more = None if more is None else more[order]
    at = np.append(_firsts(part), len(part))
    out_part, out_blob = [], []
    for a, z in zip(at[:-1], at[1:], strict=True):
        k = _firsts(keys[a:z])
        counts = np.diff(np.append(k, z - a)).astype(np.uint32)
        h = hashes[a:z]
        body = [h.tobytes()] if wide else [h.astype(np.uint32).tobytes(), (h >> U(32)).astype(np.uint16).tobytes()]
        if more is not None:
            body.append(more[a:z].tobytes())
        out_part.append(int(part[a]))
        out_blob.append(b"".join([np.uint32(len(k)).tobytes(), keys[a:z][k].tobytes(), b"" if ids is None else ids[a:z][k].tobytes(), counts.tobytes(), *body]))
    if out_part:
        yield _messages(out_part, [None] * len(out_part), out_blob)


def _read_blob(blob: bytes, wide: bool, named: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, keys, ids); ids are there if the blob is ``named``."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at = 4 + (16 if named else 8) * n
    keys = np.frombuffer(blob, np.int64, n, 4)
    counts = np.frombuffer(blob, np.uint32, n, at)
    total, at = int(counts.sum()), at + 4 * n
    if wide:
        h = np.frombuffer(blob, np.uint64, total, at)
    else:
        h = np.frombuffer(blob, np.uint32, total, at).astype(np.uint64) | (np.frombuffer(blob, np.uint16, total, at + 4 * total).astype(np.uint64) << U(32))
    return h, np.repeat(keys, counts), np.repeat(np.frombuffer(blob, np.int64, n, 4 + 8 * n), counts) if named else None


def _read_more(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n, len(blob) - 4 * n)


def probe(batches: Iterator[pa.RecordBatch], block: int, window: int, parts: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Index blocks and probes of each document, dealt by hash."""
    for batch in _filled(batches, window):
        keys = np.array(batch.keys)
        doc, pos, h = batch.runs(block)
        h = (h & U((1 << 48) - 2)) | (pos % block == 0).astype(np.uint64)
        order = np.lexsort((h & U(1), doc, h >> U(1)))
        h, doc = h[order], doc[order]
        # one entry for each hash and document; lexsort has put the block's entry last
        last = np.append((h[1:] >> U(1) != h[:-1] >> U(1)) | (doc[1:] != doc[:-1]), True)
        h, doc = h[last], doc[last]
        at = _firsts(h >> U(1))
        size = np.diff(np.append(at, len(h)))
        several = np.repeat(size > 1, size)
        yield from _settled(keys[doc[several]], h[several] >> U(1), groups)
        is_block = np.maximum.reduceat(h & U(1), at)
        d = doc[at]
        yield from _dealt((h[at] & ~U(1)) | is_block, keys[d], None, parts, wide=False)


def matched_blocks(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Entries of hashes that several documents hold, one of them as a block: (key, hits)."""
    h, keys = [], []
    for b in batches:
        done = np.array(b.column("part")) < 0
        yield b.filter(pa.array(done))
        for blob in b.column("blob").filter(pa.array(~done)):
            x = _read_blob(blob.as_py(), False, named=False)
            h.append(x[0])
            keys.append(x[1])
    if not h:
        return
    h, keys = np.concatenate(h), np.concatenate(keys)
    order = np.argsort(h, kind="stable")
    h, keys = h[order], keys[order]
    at = _firsts(h >> U(1))
    size = np.diff(np.append(at, len(h)))
    hit = np.repeat((size > 1) & (np.maximum.reduceat(h & U(1), at) > 0), size)
    yield from _settled(keys[hit], h[hit] >> U(1), groups)


def extend(docs: pa.Table, answers: pa.Table, block: int, window: int, parts: int, groups: int) -> pa.Table:
    """Full hashes of the windows that hold a hit, dealt by hash; one group of documents."""
    return pa.Table.from_batches(_extend(docs, answers, block, window, parts, groups), schema=MESSAGE)


def _extend(docs: pa.Table, answers: pa.Table, block: int, window: int, parts: int, groups: int) -> Iterator[pa.RecordBatch]:
    reach = window - block + 1
    for batch in _filled(docs.to_batches(), window, _answers_of(answers.column("blob"))):
        keys, ids = np.array(batch.keys), np.array(batch.ids)
        doc, _, h = batch.runs(block)
        h = (h & U((1 << 48) - 1)) >> U(1)
        cut = np.searchsorted(doc, np.arange(len(keys) + 1))
        hit = np.concatenate([np.isin(h[a:z], e) for a, z, e in zip(cut[:-1], cut[1:], batch.extra, strict=True)])
        total = np.concatenate([[0], np.cumsum(hit)])
        wdoc, wpos, full, more = batch.runs(window, 2)
        start = cut[wdoc] + wpos
        near = total[start + reach] > total[start]
        full, more, d = full[near], (more[near] >> U(32)).astype(np.uint32), wdoc[near]
        order = np.lexsort((ids[d], more, full))
        full, more, d = full[order], more[order], d[order]
        at = _firsts(full, more)
        size = np.diff(np.append(at, len(full)))
        later = ids[d] > np.repeat(ids[d[at]], size)
        yield from _settled(keys[d[later]], full[later], groups)
        # equal smallest ids (repeated rows) each need their own answer
        least = ~later & np.append(True, (full[1:] != full[:-1]) | (more[1:] != more[:-1]) | (d[1:] != d[:-1]))[: len(d)]
        yield from _dealt(full[least], keys[d[least]], ids[d[least]], parts, True, more[least])


def repeated_windows(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Entries whose window also stands in a document with a smaller id: (key, hashes).

    Windows are told apart by all their 96 bits; a document's own windows, which the
    answers are looked up among, by the first 64.
    """
    h, keys, ids, more = [], [], [], []
    for b in batches:
        done = np.array(b.column("part")) < 0
        yield b.filter(pa.array(done))
        for blob in b.column("blob").filter(pa.array(~done)):
            raw = blob.as_py()
            x = _read_blob(raw, True)
            for held, new in zip((h, keys, ids, more), (*x, _read_more(raw, len(x[0]))), strict=True):
                held.append(new)
    if not h:
        return
    h, keys, ids, more = np.concatenate(h), np.concatenate(keys), np.concatenate(ids), np.concatenate(more)
    order = np.lexsort((ids, more, h))
    h, keys, ids, more = h[order], keys[order], ids[order], more[order]
    at = _firsts(h, more)
    later = ids > np.repeat(ids[at], np.diff(np.append(at, len(h))))
    yield from _settled(keys[later], h[later], groups)


RESULT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def cut_out(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    """Each document's kept words: (key, id, n_words, n_removed, kept); one group of documents."""
    z, hasher, gone = zstandard.ZstdDecompressor(), Words(), _answers_of(answers.column("blob"))
    n_words, n_removed, kept = [], [], []
    for key, packed in zip(docs.column("key").to_pylist(), docs.column("packed"), strict=True):
        words = z.decompress(packed.as_py()).split()
        n_words.append(len(words))
        n_removed.append(0)
        if key in gone:
            starts = np.flatnonzero(np.isin(rolling(np.ascontiguousarray(hasher(words)[:, 0]), window), gone[key]))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            n_removed[-1] = int(covered.sum())
            words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
        kept.append(b" ".join(words).decode())
    columns = [docs.column("key").combine_chunks(), docs.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
    return pa.Table.from_arrays(columns, schema=RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per input row: key, id, n_words, n_removed, kept (kept words joined by spaces)."""
    if window % 2 == 0:
        raise ValueError("window is 2 * block - 1, an odd number")
    block, parts = (window + 1) // 2, split_count(docs.sparkSession)
    # documents meet their answers in groups, several to a task, so that a group is small
    groups = 4 * parts
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = source.select(F.pmod("key", F.lit(groups)).cast("int").alias("kb"), "key", "id", "text")
    dealt = source.mapInArrow(_compress, "kb int NOT NULL, key long NOT NULL, id long, packed binary").repartition(parts, "kb")

    def reduced(messages: DataFrame, step) -> DataFrame:
        target = F.when(F.col("part") < 0, F.col("kb")).otherwise(F.col("part"))
        return messages.repartition(parts, target).mapInArrow(lambda it: step(it, groups), MESSAGE_DDL)

    def met(answers: DataFrame, step, schema: str) -> DataFrame:
        return dealt.groupBy("kb").cogroup(answers.groupBy("kb")).applyInArrow(step, schema)

    hits = reduced(dealt.mapInArrow(lambda it: probe(it, block, window, parts, groups), MESSAGE_DDL), matched_blocks)
    windows = met(hits, lambda d, a: extend(d, a, block, window, parts, groups), MESSAGE_DDL)
    gone = reduced(windows, repeated_windows)
    return met(gone, lambda d, a: cut_out(d, a, window), "key long, id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(13)) AS j)
), a AS (
  SELECT w.doc_id, t.p, ws[t.p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), k AS (
  SELECT a.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY a.p) AS kept
  FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.p = a.p GROUP BY 1
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
