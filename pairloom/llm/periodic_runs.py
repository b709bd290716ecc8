"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a document are classed by the factor of l words that starts there, for
l = 1, 2, 3 ... A class is split by the classes of the following position; of the parts
of a class all but a largest one split others in the next round (smaller half), so the
positions moved over all rounds are n log n at most. Classes keep their members linked
in order of position: two neighbours at distance l in the classes of length l are a
square with a primitive root of l words. A distance is looked at when it ends: it was
a square if it held in the round of its own length. Squares at consecutive positions with
one period are a run.

Refinement of a document stops at the largest period a run can have (its words over the
least exponent), and classes too small to hold a run of the least exponent are left alone.
Documents are refined together in groups of about ``GROUP_WORDS`` words, each with classes
of its own, so the rounds of numpy calls are shared; a document is never cut.

Defined results: a null or empty text has no words and no run; null ids are carried as
null; repeated rows give repeated results; an empty table gives an empty result; columns
other than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, trimmed

#: words of the documents that are refined together; one document may have more
GROUP_WORDS = 400_000
#: bytes of text whose words are held at a time; one document may have more
SLICE_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... lengths[0] numbers, then those from starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _begins(sorted_: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return np.flatnonzero(new)


class Partition:
    """Classes of positions: members in segments, and linked in order of position."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        self.perm = np.argsort(codes, kind="stable")
        at = _begins(codes[self.perm])
        sizes = np.diff(np.append(at, n))
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(at)], self.size[: len(at)] = at, sizes
        self.classes = len(at)
        self.cls = np.empty(n, np.int64)
        self.cls[self.perm] = np.repeat(np.arange(len(at)), sizes)
        self.where = np.empty(n, np.int64)
        self.where[self.perm] = np.arange(n)
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        #: the round in which the distance to the next member came up
        self.since = np.ones(n, np.int64)
        #: the round of a class's last change
        self.settled = np.ones(n, np.int64)
        self.mark = np.zeros(n + 1, bool)
        self._link(self.perm, self.cls[self.perm])

    def _link(self, members: np.ndarray, cls: np.ndarray) -> None:
        """Links members, which are sorted by class and position."""
        same = cls[1:] == cls[:-1]
        self.next[members[-1:]] = -1
        self.next[members[:-1]] = np.where(same, members[1:], -1)
        self.prev[members[:1]] = -1
        self.prev[members[1:]] = np.where(same, members[:-1], -1)

    def parts_to_move(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members that leave their class, and their new classes: what the classes of the
        positions after ``at`` cut off, but of each class a largest part stays."""
        at.sort()
        key = self.cls[at] * self.n + self.cls[at + 1]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        group = _begins(key)
        length = np.diff(np.append(group, len(at)))
        group_class = self.cls[at[group]]
        first = _begins(group_class)
        c = group_class[first]
        groups = np.diff(np.append(first, len(group)))
        rest = self.size[c] - np.add.reduceat(length, first)
        most = np.maximum.reduceat(length, first)
        goes = np.ones(len(group), bool)
        split = rest < most
        if split.any():
            owner = np.repeat(np.arange(len(c)), groups)
            largest = np.flatnonzero((length == np.repeat(most, groups)) & np.repeat(split, groups))
            goes[largest[_begins(owner[largest])]] = False
        moved = at[np.repeat(goes, length)]
        new = np.repeat(self.classes + np.arange(goes.sum()), length[goes])
        self.classes += int(goes.sum())
        turned = split & (rest > 0)
        if turned.any():
            f = c[turned]
            members = self.perm[_ragged(self.start[f], self.size[f])]
            self.mark[at] = True
            members = members[~self.mark[members]]
            self.mark[at] = False
            moved = np.append(moved, members)
            new = np.append(new, np.repeat(self.classes + np.arange(len(f)), rest[turned]))
            self.classes += len(f)
        return moved, new

    def move(self, moved: np.ndarray, new: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Gives members new classes. Returns the squares (position, period) that this ends."""
        old = self.cls[moved]
        order = np.argsort(old * self.n + moved)
        by_old, old = moved[order], old[order]
        self.mark[moved] = True  # mark[-1] is a slot of its own and never set
        before, after = self.prev[by_old], self.next[by_old]
        left, right = before[~self.mark[before]], after[~self.mark[after]]
        has_left, has_right = left >= 0, right >= 0
        touched = np.append(left[has_left], by_old)
        was = self.next[touched]
        self.next[left[has_left]] = right[has_left]
        self.prev[right[has_right]] = left[has_right]

        # in the segments, what goes is swapped to the end
        first = _begins(old)
        c, n_moved = old[first], np.diff(np.append(first, len(old)))
        tail = self.start[c] + self.size[c] - n_moved
        slots = _ragged(tail, n_moved)
        there = self.perm[slots]
        stays = there[~self.mark[there]]
        free = self.where[by_old]
        free = free[free < np.repeat(tail, n_moved)]
        self.perm[free] = stays
        self.where[stays] = free
        self.mark[moved] = False

        order = np.lexsort((moved, new, self.cls[moved]))
        moved, new = moved[order], new[order]
        self.perm[slots] = moved
        self.where[moved] = slots
        self.size[c] -= n_moved
        self.settled[c] = round_ + 1
        first = _begins(new)
        self.settled[new[first]] = round_ + 1
        self.start[new[first]] = slots[first]
        self.size[new[first]] = np.diff(np.append(first, len(new)))
        self._link(moved, new)
        self.cls[moved] = new

        changed = self.next[touched] != was
        touched, was = touched[changed], was[changed]
        period = was - touched
        square = (was >= 0) & (self.since[touched] <= period) & (period <= round_)
        self.since[touched] = round_ + 1
        return touched[square], period[square]


def squares(codes: np.ndarray, most: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of the primitively rooted squares whose classes have ``need`` members.

    ``codes``: of each position, equal where words are; ``most``: its largest period, 0
    at the position after a document's last, whose code is nowhere else.
    """
    p = Partition(codes)
    found = []
    # the first splitters: all classes, but for a largest one of all
    splitters = np.flatnonzero(p.cls != np.argmax(p.size[: p.classes]))
    round_ = 1
    while len(splitters):
        at = splitters[splitters > 0] - 1
        at = at[(most[at] > round_) & (p.size[p.cls[at]] >= need)]
        if not len(at):
            break
        moved, new = p.parts_to_move(at)
        if len(moved):
            found.append(p.move(moved, new, round_))
        splitters = moved
        round_ += 1
    rest = np.flatnonzero(p.next >= 0)
    period = p.next[rest] - rest
    # a class too small to be split further is known up to the round in which it became so
    known = np.where(p.size[p.cls[rest]] >= need, most[rest], p.settled[p.cls[rest]])
    square = (p.since[rest] <= period) & (period <= known)
    found.append((rest[square], period[square]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(texts: list[list[bytes]], min_length: int = 6, min_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Of each document (a list of words) its runs (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    asked = [d for d, words in enumerate(texts) if len(words) >= min_length]
    # documents of like length share their rounds
    asked.sort(key=lambda d: len(texts[d]))
    group: list[int] = []
    held = 0
    for d in asked:
        if group and held + len(texts[d]) > GROUP_WORDS:
            _runs_of_group(texts, group, min_length, min_exponent, out)
            group, held = [], 0
        group.append(d)
        held += len(texts[d])
    if group:
        _runs_of_group(texts, group, min_length, min_exponent, out)
    return out


def _runs_of_group(texts: list[list[bytes]], group: list[int], min_length: int, min_exponent: int, out: list[list[tuple[int, int, int]]]) -> None:
    lengths = np.array([len(texts[d]) for d in group])
    starts = np.append(0, np.cumsum(lengths + 1))
    codes = np.empty(starts[-1], np.int64)
    for k, d in enumerate(group):
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        codes[starts[k] : starts[k + 1] - 1] = [number[w] for w in texts[d]]
        codes[starts[k] : starts[k + 1] - 1] += starts[k]  # a document has no more words than positions
        codes[starts[k + 1] - 1] = starts[k + 1] - 1
    most = np.repeat(lengths // min_exponent, lengths + 1)
    most[starts[1:] - 1] = 0
    at, period = squares(codes, most, max(2, min_exponent - 1))
    if not len(at):
        return
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)))
    q, s = period[first], at[first]
    n = np.diff(np.append(first, len(at))) - 1 + 2 * q
    keep = (n >= min_length) & (n >= min_exponent * q)
    owner = np.searchsorted(starts, s[keep], side="right") - 1
    for k, a, m, w in sorted(zip(owner.tolist(), (s[keep] - starts[owner]).tolist(), n[keep].tolist(), q[keep].tolist(), strict=True), key=lambda r: (r[0], r[1], r[3])):
        out[group[k]].append((a, m, w))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of runs and the first period of each run that no other run drops."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of about ``SLICE_BYTES`` of text."""
    length = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = _begins((np.cumsum(length) - length) // SLICE_BYTES).tolist()
    for lo, hi in zip(at, [*at[1:], batch.num_rows], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Per document: id, n_words, runs (start, length, period; by start, then period) and its text with
    each run cut down to its first period, words joined by a space.

    A run is a longest stretch of words with smallest period q and at least
    max(min_length, min_exponent * q) words; ``min_exponent`` is 2 or more.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole):
                    # bytes are split at space, tab, line feed, vertical tab, form feed and carriage return
                    texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
                    found = runs(texts, min_length, min_exponent)
                    flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                    ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
                    items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                    text = pa.array([b" ".join(collapsed(w, f)) for w, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), text], ["id", "n_words", "runs", "collapsed"])

        return trimmed(results())

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, SCHEMA)


def periodic_text(id_: Column, text: Column) -> Column:
    """The text whose end repeats itself, for one id in ten (by crc32), others unchanged."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    with_words = F.transform(
        F.array(words),
        lambda w: F.transform(
            F.array(F.pmod(g, F.size(w).cast("long"))),
            lambda a: F.transform(
                F.array(F.lit(1) + F.floor((F.size(w) - a) / (F.lit(3) + g % 8))),
                lambda p: F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(F.lit(0), F.size(w) - a - 1), lambda i: w[(a + i % p).cast("int")])), " "),
            )[0],
        )[0],
    )[0]
    return F.when((h % 10 == 0) & text.rlike(WORD), with_words).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of documents, after one in ten was made periodic from some word on."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text")))
    # the first of the runs with the greatest length / period; they are in order of start and period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT] || list_transform(range(8), lambda k: -1::BIGINT)))),
   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) AS h FROM documents),
a AS (SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) ELSE len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w FROM p),
x AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e),
s AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM g GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT * FROM s ANTI JOIN s o ON o.r = s.r AND o.period < s.period AND o.start <= s.start AND o.start + o.length >= s.start + s.length),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
v AS (SELECT l.* FROM u l ANTI JOIN u o ON o.r = l.r AND (o.length * l.period > l.length * o.period OR (o.length * l.period = l.length * o.period AND (o.start < l.start OR (o.start = l.start AND o.period < l.period))))),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN u ON u.r = x.r AND x.i >= u.start + u.period AND x.i < u.start + u.length GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, v.start, v.length, v.period, 1000 * v.length // v.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (r) LEFT JOIN v USING (r) LEFT JOIN k USING (r)
"""
