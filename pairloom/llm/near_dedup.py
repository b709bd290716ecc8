"""MinHash near-dedup with tensored banding, verified on full shingle sets.

Two collections of ``m`` half keys are computed for a document, ``rows`` minhashes each.
Table (i, j) of the m x m tables has as its key the pair of half key i of the first
collection and half key j of the second, so 2 * m * rows minhashes serve m * m tables of
2 * rows minhashes each. ``m`` follows from the threshold and the miss probability asked
for. Only half keys that two documents share can form a shared pair key; the others are
dropped before keys are paired.

A bucket is never expanded into pairs. In each of a few rounds every bucket that holds
several components has a head (the row in most buckets, then by hash), against which its members
of other components are verified (full sets, exact); what links is merged. A link that
is then still missing joins two members x, y of one bucket of which x, say, is in another
component than the bucket's smallest set b, so J(x, b) < t. As b is no larger than x and
y, |x & y| >= t / (1 + t) * (|x| + |y|) > |x & b|: x and y share a shingle that b has
not. So members of buckets that still hold several components are compared where they
share such an added shingle, by prefix filtering: of x's added shingles, rarest first,
all but as many as x needs to share, less one, are looked up. This is done in tiles: the
members outside the head's component, and apart from them the others, are cut into slices
of about ``TILE`` shingles, and a task gets two slices at a time, one of them outside, as
what they add to the head's set and miss of it, which is enough to count what two members
share. Links that connect leave a tile, at most one fewer than it has components. That
finds every missing connection, in a group of any size, without a cap; the rounds only
make the last step small.

Documents with equal sets are merged into a class before all this and expanded at the
end. A class gets its number once, in a written table, and is tied to rows by a hash of
the set and to its text by a hash of the text, so passes over the input need not see the
same splits.

Defined results: a null text counts as empty; a text without words has no shingles and
links to nothing; null ids are classed under a null component unless their class has
another id; repeated rows give repeated results; an empty table gives an empty result;
other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, pick_rows, row_key, settings, trimmed

MASK = (1 << 64) - 1
#: rounds of verification against a head per bucket before the exact last step
ROUNDS = 2
#: shingles of a slice of a head's members
TILE = 100_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between space and \\x09-\\x0D (what bytes.split cuts at)."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, k: int) -> set:
    w = words_of(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k)), strict=False))


def tables_for(threshold: float, rows: int, miss: float) -> int:
    """Half keys in each collection so that a pair at the threshold is missed with ``miss`` at most."""
    return max(1, math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, remembered for the words of this task (at most ``keep``)."""

    def __init__(self, keep: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.keep = keep

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.keep:
            self.seen.clear()
        seen, h = self.seen, xxhash.xxh64_intdigest
        for w in set(words).difference(seen):
            seen[w] = h(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles (of the whole sequence if shorter)."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, n if n < k else 0, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(3) + words[i : n - width + 1 + i])
    return np.unique(out)


def signatures(batches: Iterator[pa.RecordBatch], k: int, m: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, text_key, text) to (id, text_key, n_shingles, set_key, keys: 2 * m half keys)."""
    rng = np.random.default_rng(seed)
    salts = rng.integers(0, MASK, 2 * m * rows, dtype=np.uint64, endpoint=True)
    hasher = Hasher()
    for batch in batches:
        sizes, set_keys, keys = [], [], []
        for text in batch.column("text"):
            s = shingle_hashes(hasher(words_of(text.as_py())), k)
            sizes.append(len(s))
            if not len(s):
                set_keys.append(None)
                keys.append(np.zeros(0, np.int64))
                continue
            set_keys.append(xxhash.xxh128_digest(s.tobytes()))
            low = np.array([_mix(s ^ salt).min() for salt in salts]) if len(s) > 4096 else _mix(s[None, :] ^ salts[:, None]).min(1)
            half = low.reshape(2 * m, rows)
            key = np.arange(1, 2 * m + 1, dtype=np.uint64)
            for r in range(rows):
                key = _mix(key * np.uint64(5) + half[:, r])
            keys.append(key.view(np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(set_keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
            names=["id", "text_key", "n_shingles", "set_key", "keys"],
        )


def _hashes(shingles: set) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g)) - (1 << 63) for g in shingles), np.int64, len(shingles))


def _verify(batches: Iterator[pd.DataFrame], k: int, with_sets: bool, carried: list[str]) -> Iterator[pd.DataFrame]:
    """Exact sizes of intersection and union for rows (a, b, text_a, text_b), hashes of the
    shingles that only a or only b has, and ``carried`` columns; rows sorted by b keep its set."""
    last, kept, none = None, set(), np.zeros(0, np.int64)
    for pdf in (batch.iloc[at : at + 500] for batch in batches for at in range(0, len(batch), 500)):
        inter, union, added, missing = [], [], [], []
        for b, ta, tb in zip(pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
            if b != last:
                last, kept = b, shingle_set(tb, k)
            s = shingle_set(ta, k)
            n = len(s & kept)
            inter.append(n)
            union.append(len(s) + len(kept) - n)
            added.append(_hashes(s - kept) if with_sets else none)
            missing.append(_hashes(kept - s) if with_sets else none)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "inter": inter, "uni": union, "added": added, "missing": missing, **{c: pdf[c] for c in carried}})


def verified(pairs: DataFrame, texts: DataFrame, k: int, with_sets: bool = False) -> DataFrame:
    """pairs (a, b, and longs that are carried along) with exact inter and uni; texts: (row, text) of all rows named in pairs."""
    a = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    carried = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(a, "a").join(b, "b").sortWithinPartitions("b")
    schema = ", ".join(["a long, b long, inter long, uni long, added array<long>, missing array<long>", *(f"{c} long" for c in carried)])
    return both.mapInPandas(lambda it: trimmed(_verify(it, k, with_sets, carried)), schema)


def components(links: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """Connected components of links (a, b): (row, component), smallest row of each.

    Every round each row takes the smallest label among its neighbours and itself, then
    the label's own label. Labels only fall, so it ends when no label changes. Each round
    is a written table; nothing is collected but the number of changes.
    """
    edges = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    edges = tmp.save(edges.union(edges.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), f"{name}-edges")
    labels = tmp.save(edges.groupBy("node").agg(F.min("near").alias("m")).select(F.col("node").alias("row"), F.least("node", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("row").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("m"))
        low = labels.join(near.withColumnRenamed("node", "row"), "row").select("row", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("row").alias("label"), F.col("label").alias("top"))
        new = low.join(up, "label", "left").select("row", "old", F.coalesce(F.least("label", "top"), "label").alias("label"))
        new = tmp.save(new, f"{name}-{step}")
        done = new.where("label <> old").isEmpty()
        tmp.drop(f"{name}-{step - 1}")
        labels = new.select("row", "label")
        if done:
            return labels.withColumnRenamed("label", "component")


def _against_heads(members: DataFrame, comp: DataFrame, head: Column) -> DataFrame:
    """(a, b, h, comp, head_comp): members a of buckets of several components, with the bucket's head b; h is what chose it."""
    labels = comp.withColumnRenamed("row", "rep")
    of = members.join(labels, "rep")
    per = of.groupBy("key").agg(head.alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    heads = per.select("key", "h", F.col("h.rep").alias("b")).join(labels.select(F.col("rep").alias("b"), F.col("component").alias("head_comp")), "b")
    return of.join(heads, "key").where("rep <> b").select(F.col("rep").alias("a"), "b", "h", F.col("component").alias("comp"), "head_comp")


def _merged(comp: DataFrame, links: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """Components after further links (a, b): found over the components as nodes."""
    of = lambda side: comp.select(F.col("row").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    top = components(edges, tmp, f"merge-{name}").select(F.col("row").alias("component"), F.col("component").alias("top"))
    out = comp.join(top, "component", "left").select("row", F.coalesce("top", "component").alias("component"))
    return tmp.save(out, f"comp-{name}")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, rows: int = 3, miss: float = 1e-4, seed: int = 1) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_key, group.

    ``kept`` is true for the rows whose id is the component's smallest. ``group`` is the
    same number for all rows of a component, null for rows without words; ``text_key`` is
    the MD5 of the text.
    """
    # whole texts travel in pairs: a batch holds few of them
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        return _classed(docs, id_col, text_col, shingle, threshold, rows, miss, seed)


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, rows: int, miss: float, seed: int) -> DataFrame:
    tmp = Scratch(docs.sparkSession, "near-dedup")
    m = tables_for(threshold, rows, miss)
    percent = round(threshold * 10_000)
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    schema = "id long, text_key binary, n_shingles long, set_key binary, keys array<long>"
    signed = tmp.save(source.mapInArrow(lambda it: trimmed(signatures(it, shingle, m, rows, seed)), schema), "signed")

    # equal sets are one class: a number, which is written and never computed again, the key of one text, the smallest id
    classes = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("text_key").alias("text_key"), F.min("id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")
    )
    classes = tmp.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    halves = classes.select("rep", "n", F.posexplode("keys").alias("i", "key"))
    shared = halves.groupBy("i", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "key")
    # a collection's half keys that nobody shares cannot be part of a shared pair key
    halves = halves.join(shared, ["i", "key"], "left_semi").groupBy("rep", "n").agg(
        F.collect_list(F.when(F.col("i") < m, F.struct("i", "key"))).alias("first"), F.collect_list(F.when(F.col("i") >= m, F.struct("i", "key"))).alias("second")
    )
    tables = halves.select("rep", "n", F.explode("first").alias("x"), "second").select("rep", "n", "x", F.explode("second").alias("y"))
    keyed = tmp.save(tables.select("rep", "n", F.xxhash64("x.i", "x.key", "y.i", "y.key").alias("key")), "keyed")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = tmp.save(keyed.join(several, "key", "left_semi"), "members")
    tmp.drop("keyed")
    # those in most buckets go first as heads: what a group's texts were made from is in most of the group's buckets
    degree = members.groupBy("rep").agg((-F.count(F.lit(1))).alias("rank"))
    members = tmp.save(members.join(degree, "rep"), "ranked")

    # a text of each class that shares a bucket, found by its key; copies are merged before they move
    wanted = classes.select("rep", "text_key").join(members.select("rep").distinct(), "rep", "left_semi")
    single = source.groupBy("text_key").agg(F.first("text").alias("text"))
    texts = tmp.save(single.join(wanted, "text_key").select(F.col("rep").alias("row"), "text"), "texts")

    def close(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("inter") * 10_000 >= F.col("uni") * percent).select("a", "b")

    found = members.select(F.col("rep").alias("row"), F.col("rep").alias("component")).distinct()
    for step in range(ROUNDS):
        head = F.min(F.struct(F.col("rank") if not step else F.xxhash64("rep", F.lit(step)), "rep"))
        pairs = tmp.save(_against_heads(members, found, head).where("comp <> head_comp").groupBy("a").agg(F.min("h").alias("h")).select("a", F.col("h.rep").alias("b")), f"round-{step}")
        links = close(verified(pairs, texts, shingle))
        found = _merged(found, links, tmp, str(step))
    # what a pair's components are travels with it
    groups = _against_heads(members, found, F.min(F.struct("n", "rep"))).select("a", "b", F.col("comp").alias("ca"), F.col("head_comp").alias("cb")).distinct()
    stars = verified(tmp.save(groups, "open"), texts, shingle, True).withColumn("weight", F.size("added") + F.size("missing"))
    stars = tmp.save(stars, "stars")
    more = tmp.save(close(stars).union(close(verified(_missing(stars, percent / 10_000, tmp), texts, shingle))), "rest")
    found = _merged(found, more, tmp, "last")

    labelled = classes.select("set_key", "rep", "min_id").join(found.withColumnRenamed("row", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = labelled.groupBy("component").agg(F.min("min_id").alias("component_id"))
    by_class = labelled.join(lowest, "component").select("set_key", "component_id", "component")
    out = signed.select("id", "text_key", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "text_key", F.col("component").alias("group"))


def _missing(stars: DataFrame, t: float, tmp: Scratch) -> DataFrame:
    """Links (a, b) across components among the members of a head, by 64-bit hashes of shingles.

    A link joins a member outside the head's component to any other member. So outside
    members are cut into slices, and so are the others; a tile is two outside slices or an
    outside slice and another one. The many copies around a head move once for each slice
    of the few outside.
    """
    # who goes to which tile is settled on narrow rows; the sets then move once to meet it and once to their tiles
    of = stars.select("a", "b", "weight", "ca", "cb").withColumn("outside", F.col("ca") != F.col("cb"))
    count = lambda which: F.ceil(F.sum(F.when(F.col("outside") == which, F.col("weight"))) / TILE)
    slices = of.groupBy("b").agg(F.max("outside").alias("mixed"), F.greatest(count(True), F.lit(1)).cast("int").alias("out"), F.greatest(count(False), F.lit(1)).cast("int").alias("ins"))
    of = of.join(slices.where("mixed"), "b").withColumn("own", F.pmod(F.xxhash64("a"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("ins"))).cast("int"))
    dealt = tmp.save(of.select("a", "b", "outside", "own", "out", "ins"), "dealt")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda inner, lo, hi: F.struct(F.lit(inner).alias("inner"), lo.alias("lo"), hi.alias("hi"))
    own = F.col("own")
    tiles = F.when(
        F.col("outside"),
        F.concat(F.transform(numbers(F.col("out")), lambda q: place(False, F.least(own, q), F.greatest(own, q))), F.transform(numbers(F.col("ins")), lambda q: place(True, own, q))),
    ).otherwise(F.transform(numbers(F.col("out")), lambda p: place(True, p, own)))
    sent = stars.join(dealt, ["a", "b"]).withColumn("tile", F.explode(tiles))
    sent = sent.select("b", "tile.*", "own", "a", "inter", "uni", "added", "missing", "ca", "outside")
    links = sent.groupBy("b", "inner", "lo", "hi").applyInPandas(lambda pdf: _tile(pdf, t), "a long, b long")
    return tmp.save(links.distinct(), "links")


def _tile(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Links between the two slices of a tile (or within its one slice): enough to connect all that link."""
    inner, cross = pdf["inner"].iat[0], pdf["lo"].iat[0] != pdf["hi"].iat[0]
    rows, comp, own, outside = (pdf[c].to_numpy() for c in ("a", "ca", "own", "outside"))
    inter, uni = pdf["inter"].to_numpy(), pdf["uni"].to_numpy()
    added = [np.asarray(x, np.int64) for x in pdf["added"]]
    size = inter + np.array([len(x) for x in added])
    head = int(uni[0] - len(added[0]))
    values, where, counts = np.unique(np.concatenate(added), return_inverse=True, return_counts=True)
    # rarest first, the same order for all members of the tile
    place = np.empty(len(values), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(values))
    cuts = np.cumsum([0, *map(len, added)])
    need = np.maximum(1, np.ceil(t / (1 + t) * (size + head) - 1e-9).astype(np.int64) - inter)
    posting: dict[int, list[int]] = {}
    prefixes = []
    for i in range(len(rows)):
        g = where[cuts[i] : cuts[i + 1]]
        if outside[i]:
            g = g[np.argsort(place[g])][: max(0, len(g) - need[i] + 1)]
        prefixes.append(g[counts[g] > 1].tolist())
        for x in prefixes[-1]:
            posting.setdefault(x, []).append(i)
    sets: dict[int, tuple[frozenset, frozenset]] = {}
    missing = pdf["missing"].to_numpy()

    def parts(i: int) -> tuple[frozenset, frozenset]:
        if i not in sets:
            sets[i] = frozenset(where[cuts[i] : cuts[i + 1]].tolist()), frozenset(missing[i].tolist())
        return sets[i]

    #: components already joined in this tile need no second link
    top: dict[int, int] = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    for i in np.flatnonzero(outside).tolist():
        for j in set().union(*(posting[x] for x in prefixes[i])):
            if (inner and outside[j]) or (not inner and ((cross and own[i] == own[j]) or (outside[j] and j < i))):
                continue
            ci, cj = root(comp[i]), root(comp[j])
            if ci == cj:
                continue
            small, large = sorted((int(size[i]), int(size[j])))
            if small < t * large - 1e-9:
                continue
            (ai, mi), (aj, mj) = parts(i), parts(j)
            both = head - len(mi | mj) + len(ai & aj)
            if both >= t * (small + large - both) - 1e-9:
                out.append((int(rows[i]), int(rows[j])))
                top[ci] = cj
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, all without words.

    Rows are named by id and text, never by position.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where("group is not null")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key"))
    stays = found.groupBy("group").agg(best.alias("s")).select(row_key(F.col("s.id"), F.hex("s.text_key")).alias("key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    own = row_key(F.col(id_col).cast("long"), F.hex(text_key(text)))
    return pick_rows(docs.where(worded), own, stays).unionByName(docs.where(~worded))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, threshold=0.85).drop("text_key", "group")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id AS v, doc_id AS u FROM documents
  UNION
  SELECT r.v, e.y FROM r JOIN e ON r.u = e.x
), k AS (SELECT v, min(u) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
