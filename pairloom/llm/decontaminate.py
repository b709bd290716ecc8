"""Benchmark decontamination by edit distance in words.

A document is contaminated by an item of m words if some passage of it is within
``floor(share * m)`` word edits. Words are lower-cased and stripped of all but letters
and digits; what is then empty is no word.

CGK random walks map windows of the item's size to strings in which edit distance becomes
Hamming distance; tables of sampled coordinates (bit-sampling LSH), repeated with fresh
walks, are the index: an item is found where a window of a document shares a table's key
with it. Sizes are classes about 15 per cent apart, an item is indexed by as many of its
first words as its class has; an item of more than ``LONGEST`` words by each of several
equal parts, one of which has no more than its share of the edits. The number of walks of
a class grows until simulated passages at the largest distance are found with probability
``recall``; if that takes more than ``GIVE_UP`` walks, it is an error, never a loss. What
is found is verified with the exact edit distance between item and passage.

Every window of every document is probed, but for those that cannot be close to anything:
a window of M words within k edits of an item holds M - k words of the items of its class
at least, and M - 1 - 2 k pairs of neighbouring words of theirs, which running counts tell. Items reach the tasks in blocks of at most
``block_bytes`` of text, each a pass over the documents; the blocks are a broadcast of
that bounded size.

Defined results: a null or empty text, or item, matches nothing; null ids are carried as
null; repeated documents give repeated results, repeated items a row each; an empty table
on either side gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, trimmed

STRIP = re.compile(r"[\W_]+")
SAMPLED = 3
TABLES = 16
#: walks are drawn, fitted and probed in groups
GROUP = 4
GIVE_UP = 2048
#: words of the longest window
LONGEST = 100
#: words of documents that are probed at once
PASS_WORDS = 400_000
PAD = 0xFFFFFFFF
U32, U64 = np.uint32, np.uint64
SCHEMA = "id long, item_id long, distance int, item_words int, word_start long, word_end long"


def bare(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else STRIP.sub("", word)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


#: ASCII characters that are neither letters, digits nor white space
DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())


def bare_words(text: str) -> list[str]:
    """The same words, faster for long texts: characters are dropped from the text, not from each word."""
    words = text.lower().encode().translate(None, DROPPED).decode().split()
    return words if "".join(words).isalnum() else [w for w in (w if w.isalnum() else STRIP.sub("", w) for w in words) if w]


def sizes() -> list[int]:
    """Window sizes, each at most 15 per cent (or one word) larger than the one before."""
    out = [1]
    while out[-1] < LONGEST:
        out.append(min(LONGEST, max(out[-1] + 1, out[-1] * 23 // 20)))
    return out


def size_of(m: int) -> int:
    return max(n for n in sizes() if n <= m)


def parts_of(m: int, edits: int) -> tuple[int, list[int], int]:
    """(window size, offsets of the parts, edits in the best part) of an item of m words."""
    n = -(-m // LONGEST)
    return size_of(m // n), [i * (m // n) for i in range(n)], edits // n


def walks(windows: np.ndarray, group: int, seed: int) -> np.ndarray:
    """Table keys (windows, GROUP * TABLES) of the walks of a group over rows of m symbols; 0 where the key reads padding.

    In each of 2 m steps (of the 3 m of the embedding; the others mostly read the padding)
    a walk puts out its symbol and moves on if the random bit of (walk, step, symbol) says so.
    """
    n, m = windows.shape
    coords = np.random.default_rng([seed, m, group]).integers(0, 2 * m, (GROUP, TABLES, SAMPLED))
    padded = np.concatenate([windows.astype(U32), np.full((n, 1), PAD, U32)], 1).ravel()
    last = (np.arange(n, dtype=np.int64) * (m + 1) + m)[None, :]
    at = np.repeat(last - m, GROUP, 0)
    salt = (np.arange(group * GROUP, (group + 1) * GROUP).astype(U32) * U32(2246822519))[:, None]
    wanted = defaultdict(list)
    for r, t, c in np.ndindex(coords.shape):
        wanted[int(coords[r, t, c])].append((r, t, c))
    symbols = np.zeros((SAMPLED, GROUP * TABLES, n), U32)
    for step in range(max(wanted) + 1):
        sym = padded.take(at)
        for r, t, c in wanted.get(step, ()):
            symbols[c, r * TABLES + t] = sym[r]
        h = sym
        h ^= U32((step * 2654435761) & PAD)
        h *= U32(0x85EBCA6B)
        h ^= salt
        h ^= h >> U32(15)
        h *= U32(0xC2B2AE35)
        h >>= U32(16)
        h &= U32(1)
        at += h
        np.minimum(at, last, out=at)
    keys = np.repeat((np.arange(GROUP * TABLES) + group * GROUP * TABLES).astype(U64)[:, None], n, 1)
    for c in range(SAMPLED):
        keys = (keys ^ symbols[c]) * U64(0x9E3779B97F4A7C15)
        keys ^= keys >> U64(29)
    return np.where((symbols == PAD).any(0), U64(0), keys | U64(1)).T


@lru_cache(maxsize=1024)
def fitted_groups(m: int, k: int, recall: float, seed: int, trials: int = 1000) -> int:
    """Groups of walks after which ``recall`` of simulated passages with k edits share a key with their item."""
    rng = np.random.default_rng([seed, m, k])
    items = rng.integers(1, 1 << 30, (trials, m))
    edited = np.zeros((trials, m), np.int64)
    for i, w in enumerate(items):
        x = w.tolist()
        for _ in range(k):
            p, kind = int(rng.integers(0, max(1, len(x)))), rng.integers(0, 3)
            if kind == 0 and x:
                x[p] = int(rng.integers(1 << 30, 1 << 31))
            elif kind == 1:
                x.insert(p, int(rng.integers(1 << 30, 1 << 31)))
            elif x:
                x.pop(p)
        edited[i] = (x + rng.integers(1 << 30, 1 << 31, m).tolist())[:m]
    lost = np.arange(trials)
    for group in range(GIVE_UP // GROUP):
        a, b = walks(items[lost], group, seed), walks(edited[lost], group, seed)
        lost = lost[~((a == b) & (a > 0)).any(1)]
        if len(lost) <= (1 - recall) * trials:
            return group + 1
    raise ValueError(f"{GIVE_UP} walks do not find passages with {k} edits in {m} words with probability {recall}")


def pair_places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A place in a table of 2**bits for each pair of neighbouring words."""
    h = (a.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (b.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return ((h * U64(0xD6E8FEB86659FD93)) >> U64(64 - bits)).astype(np.int64)


def edit_rows(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits from the item to a passage of the text that ends at each position."""
    n = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - n) + n
    return row


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the closest passage, first among equals."""
    row = edit_rows(item, text)
    end = int(row.argmin())
    back = edit_rows(item[::-1], text[:end][::-1])
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end


class Block:
    """A block of items as the tasks get it."""

    def __init__(self, items: list[tuple[int, str | None]], share: float, recall: float, seed: int):
        self.seed = seed
        vocabulary: dict[str, int] = {}
        self.ids, self.words, self.edits = [], [], []
        for id_, text in items:
            words = item_words(text)
            if words:
                self.ids.append(id_)
                self.words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]))
                self.edits.append(int(share * len(words)))
        self.vocabulary = vocabulary
        #: window size to (item, offset of the part in it)
        self.parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        most: dict[int, int] = defaultdict(int)
        for i, (w, k) in enumerate(zip(self.words, self.edits, strict=True)):
            m, offsets, edits = parts_of(len(w), k)
            self.parts[m] += [(i, o) for o in offsets]
            # what the class's longest item may have, so that a block does not decide on the walks
            most[m] = max(most[m], edits, int(share * (min(n for n in [*sizes(), LONGEST + 1] if n > m) - 1)))
        self.parts = dict(sorted(self.parts.items()))
        #: window size to the least number of words of its items that a close window holds, and to groups of walks
        self.least = {m: max(1, m - most[m]) for m in self.parts}
        self.groups = {m: fitted_groups(m, min(most[m], m - 1), recall, seed) for m in self.parts}
        #: which sizes a word's items have
        self.sizes = {m: np.zeros(len(vocabulary) + 1, bool) for m in self.parts}
        #: which sizes the pairs of neighbouring words have that share a place: a bit for each size
        self.pair_bits = max(12, int(8 * sum(map(len, self.words)) + 1).bit_length())
        self.pairs = np.zeros(1 << self.pair_bits, U32)
        #: (size, group) to sorted keys and the part each is of
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for m, parts in self.parts.items():
            rows = np.stack([self.words[i][o : o + m] for i, o in parts])
            self.sizes[m][rows.ravel()] = True
            self.pairs[pair_places(rows[:, :-1], rows[:, 1:], self.pair_bits).ravel()] |= U32(1 << sizes().index(m))
            for g in range(self.groups[m]):
                keys = np.concatenate([walks(rows[at : at + 4096], g, seed) for at in range(0, len(rows), 4096)])
                part = np.repeat(np.arange(len(rows), dtype=np.int32), keys.shape[1])
                keys = keys.ravel()
                part, keys = part[keys > 0], keys[keys > 0]
                order = np.argsort(keys, kind="stable")
                self.tables[m, g] = keys[order], part[order]


class Matcher:
    def __init__(self, block: Block):
        self.block = block
        self.seen = np.zeros(len(block.vocabulary) + 1, bool)
        self.seen_pairs = np.zeros(1 << 16, bool)

    def numbered(self, text: str) -> np.ndarray:
        """Vocabulary numbers of the text's words (0: not in any item); empty words are left out."""
        words = bare_words(text)
        return np.fromiter(map(self.block.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def pair_sizes(self, words: np.ndarray) -> np.ndarray:
        """The sizes, as bits, of the pair of words at each position; none where a word is in no item."""
        b = self.block
        out = np.zeros(len(words), U32)
        known = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        out[known] = b.pairs[pair_places(words[known], words[known + 1], b.pair_bits)]
        return out

    def starts(self, words: np.ndarray, pairs: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """Where windows of one size begin that may be close to an item; ends: of each word's document."""
        b = self.block
        count = np.concatenate([[0], np.cumsum(b.sizes[size][words])])
        end = np.minimum(np.arange(len(words)) + size, ends)
        starts = np.flatnonzero(count[end] - count[:-1] >= b.least[size])
        edits = size - b.least[size]
        if size - 1 - 2 * edits > 0 and len(starts):
            # a close passage has up to size + edits words; each edit breaks two pairs
            count = np.concatenate([[0], np.cumsum((pairs >> U32(sizes().index(size))) & U32(1), dtype=np.int64)])
            end = np.minimum(starts + size + edits, ends[starts]) - 1
            starts = starts[count[np.maximum(end, starts)] - count[starts] >= size - 1 - 2 * edits]
        return starts

    def probed(self, words: np.ndarray, pairs: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, part) of all windows of one size that share a table's key with a part."""
        b, found = self.block, [np.zeros(0, np.int64)]
        starts = self.starts(words, pairs, ends, size)
        parts = len(b.parts[size])
        for at in range(0, len(starts), 2048):
            some = starts[at : at + 2048]
            place = some[:, None] + np.arange(size)
            windows = np.where(place < ends[some][:, None], words[place.clip(max=len(words) - 1)], 0)
            for g in range(b.groups[size]):
                index, of = b.tables[size, g]
                if not len(index):
                    continue
                keys = walks(windows, g, b.seed)
                lo = np.searchsorted(index, keys)
                window, key = np.nonzero(index[lo.clip(max=len(index) - 1)] == keys)
                if len(window):
                    first = lo[window, key]
                    n = np.searchsorted(index, keys[window, key], side="right") - first
                    entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append(np.unique(some[np.repeat(window, n)] * parts + of[entry]))
        pairs = np.unique(np.concatenate(found))
        return pairs // parts, pairs % parts

    def matches(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document (item, distance, start, end), the closest passage for each item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        cuts = np.cumsum([0, *map(len, docs)])
        if not cuts[-1]:
            return out
        words, ends = np.concatenate(docs), np.repeat(cuts[1:], np.diff(cuts))
        pairs = self.pair_sizes(words)
        placed: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size, parts in self.block.parts.items():
            starts, part = self.probed(words, pairs, ends, size)
            doc = np.searchsorted(cuts, starts, side="right") - 1
            for d, p, start in zip(doc.tolist(), part.tolist(), (starts - cuts[doc]).tolist(), strict=True):
                item, offset = parts[p]
                placed[d, item].add(start - offset)
        for (d, item), at in sorted(placed.items()):
            best = self._verified(docs[d], item, sorted(at))
            if best:
                out[d].append((item, *best))
        return out

    def _verified(self, words: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """The closest passage around windows that start (or would start) there; those that overlap are one stretch."""
        w, k = self.block.words[item], self.block.edits[item]
        best, at = None, 0
        while at < len(starts):
            lo, hi = starts[at] - k, starts[at] + len(w) + 2 * k
            while at + 1 < len(starts) and starts[at + 1] - starts[at] <= k + 1:
                at += 1
                hi = starts[at] + len(w) + 2 * k
            at += 1
            lo, hi = max(lo, 0), min(hi, len(words))
            if lo < hi and self._may_hold(w, k, words[lo:hi]):
                d, a, z = best_passage(w, words[lo:hi])
                if d <= k and (best is None or (d, a + lo) < best[:2]):
                    best = (d, a + lo, z + lo)
        return best


    def _may_hold(self, item: np.ndarray, edits: int, text: np.ndarray) -> bool:
        """A passage within the edits holds all but so many of the item's words, and all but twice as many of its pairs."""
        self.seen[text] = True
        shared = np.count_nonzero(self.seen[item])
        self.seen[text] = False
        if shared < len(item) - edits:
            return False
        if len(item) - 1 - 2 * edits <= 0:
            return True
        there = pair_places(text[:-1], text[1:], 16)
        self.seen_pairs[there] = True
        shared = np.count_nonzero(self.seen_pairs[pair_places(item[:-1], item[1:], 16)])
        self.seen_pairs[there] = False
        return bool(shared >= len(item) - 1 - 2 * edits)


def _judged(texts: pa.Array, matcher: Matcher) -> Iterator[list[tuple[int, int, int, int]]]:
    """Matches of each text, in order; short texts are probed together."""
    held, n = [], 0
    for text in texts:
        held.append(matcher.numbered(text.as_py() or ""))
        n += len(held[-1])
        if n >= PASS_WORDS:
            yield from matcher.matches(held)
            held, n = [], 0
    yield from matcher.matches(held)


def _matched(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(block)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for id_, found in zip(b.column("id"), _judged(b.column("text"), matcher), strict=True):
            for item, d, a, z in found:
                rows.append((id_.as_py(), block.ids[item], d, len(block.words[item]), a, z))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _clean(batches: Iterator[pa.RecordBatch], block: Block, at: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(block)
    for b in batches:
        yield b.filter(pa.array([not found for found in _judged(b.column(at), matcher)], pa.bool_()))


def blocks(items: DataFrame, id_col: str, text_col: str, share: float, recall: float, seed: int, block_bytes: int) -> Iterator[Block]:
    """Items in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).orderBy("id", "text").collect()
        yield Block([(r.id, r.text) for r in part], share, recall, seed)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.2, recall: float = 0.99, seed: int = 7, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and item that it holds: id, item_id, distance, item_words, word_start, word_end (of its words)."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in blocks(items, item_id, item_text, share, recall, seed, block_bytes):
        sent = sc.broadcast(block)
        out = out.unionByName(source.mapInArrow(lambda it, sent=sent: trimmed(_matched(it, sent.value)), SCHEMA))
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.2, recall: float = 0.99, seed: int = 7, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass a block, no shuffle."""
    at, sc = docs.columns.index(text_col), docs.sparkSession.sparkContext
    for block in blocks(items, item_id, item_text, share, recall, seed, block_bytes):
        sent = sc.broadcast(block)
        docs = docs.mapInArrow(lambda it, sent=sent: trimmed(_clean(it, sent.value, at)), docs.schema)
    return docs


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), benchmark(spark, sf_dir))
