"""Secret scans with a randomness test battery, in DataFrame functions only.

Fixed patterns give the base spans. The method adds every token that passes for random:
maximal runs of token characters, with ``=`` only as padding at the end of a run (so the
value of KEY=VALUE is a token of its own), get an inferred encoding (hex, base32, base64,
base64url; digits alone count as hex, letters alone as what they fit), and three tests of randomness over its alphabet: chi-squared uniformity,
runs about the middle symbol, and lag-1 serial correlation. The smallest of the three
p-values, times three, is a token's p-value. Benjamini-Hochberg at level ``q`` within
each band of encoding and length (powers of two) then tells structured tokens from
random ones, so that a short token, for which the tests have little power, is judged
against its own kind. What is rejected is not reported.

That bounds the random tokens that are missed. False reports are bounded by decoys: for each
token of a document one of the same length is cut from its words run together (in lower
case, capitals, with ``_`` or with numbers), which is what structured tokens look like. At a
p-value a band's share of false reports is estimated as that of the decoys that reach it,
of the style of which most do, times the share of tokens that are structured (judged by
those at p-values where random ones are rare), over that of tokens that reach it. A band reports no more than the
p-values at which the estimate is ``q`` at most; a band in which structured tokens pass for
random reports fewer tokens or none.

The band's cut is found from a histogram of p-values over all rows (``BINS`` bins by
log p, upper edges, so never more rejections than the exact procedure); per band one
histogram goes to the driver. Each document is then scanned on its own: no shuffle of
texts, no join.

Defined results: a null or empty text has no spans (counts 0, SHA-256 of the empty
string); a null id is returned as null; repeated rows give repeated results; an empty
table gives an empty result; no column but id and text is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A maximal run of one class is what the open pattern matches, so the least length can
# stand in the pattern; the look-behind keeps the search from retrying inside a run.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
#: ways to run words together
STYLES = 4
#: a plain word, no part of a token
WORD = r"(?<![A-Za-z0-9+/_=-])([A-Za-z]{2,15})(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")
#: matches whose positions are added up in one array
RUN = 128
BINS = 400
BINS_PER_DECADE = 20
#: bins from here on (p under 0.01) hold one random token in a hundred
RARE = 2 * BINS_PER_DECADE

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: (pattern without padding, alphabet), tried in this order
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)


def located(text: Column, pattern: str, least_group: int = 0) -> Column:
    """array<struct<start, end, tok>> of the leftmost non-overlapping matches.

    Positions are code points: the pieces between the matches and the matches add up.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tok"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,tok:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["tok"])
        one = F.struct(start.alias("start"), end.alias("end"), x["tok"].alias("tok"))
        return F.when(x["tok"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans")))

    # an array grows by copying: runs of RUN matches have positions of their own, then each run is moved by those before it
    starts = F.sequence(F.lit(1), F.size(found), F.lit(RUN))
    runs = F.transform(starts, lambda i: F.aggregate(F.slice(found, i, F.lit(RUN)), empty, step))
    before = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"],
    )
    moved = lambda r, n: F.transform(r["spans"], lambda s: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end"), s["tok"].alias("tok")))
    spans = F.flatten(F.zip_with(runs, before, moved))
    if least_group:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["tok"], pattern, 1)) >= least_group)
    return spans


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<start:int,end:int,tok:string>>")
    lowered = F.lower(text)
    some = lowered.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        some = some | lowered.contains(k)
    return {
        "assign": F.when(some, located(text, ASSIGN, 8)).otherwise(none),
        "access": F.when(text.contains("AKIA"), located(text, ACCESS)).otherwise(none),
        "hex": F.when(text.rlike(HEX), located(text, HEX)).otherwise(none),
    }


def normal_tail(z: Column) -> Column:
    """P(|N(0,1)| >= |z|), rational approximation of erfc with error under 2e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def battery(tokens: Column) -> Column:
    """array<struct<start, end, band, p>> of the tokens that have an inferred encoding."""

    def encoded(s: Column) -> Column:
        bare = F.regexp_replace(s["tok"], "=+$", "")
        alphabet = F.lit(None).cast("string")
        for pattern, letters in reversed(ENCODINGS):
            alphabet = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), bare.alias("bare"), alphabet.alias("abc"))

    def symbols(s: Column) -> Column:
        x = F.transform(F.split(s["bare"], ""), lambda c: F.position(c, s["abc"]).cast("double") - 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("x"), F.length(s["abc"]).cast("double").alias("k"))

    def moments(s: Column) -> Column:
        x, n = s["x"], F.size(s["x"]).cast("double")
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda v: v == c)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(x, lambda v: v >= s["k"] / 2)).cast("double")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("x"), s["k"].alias("k"), n.alias("n"), (total / n).alias("m"), squares.alias("sq"), high.alias("hi"))

    def statistics(s: Column) -> Column:
        x, n, k, m, hi = s["x"], s["n"], s["k"], s["m"], s["hi"]
        head, tail = F.slice(x, F.lit(1), n.cast("int") - 1), F.slice(x, F.lit(2), n.cast("int") - 1)
        chi = k / n * s["sq"] - n
        runs = 1 + F.aggregate(F.zip_with(head, tail, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        lag = F.aggregate(F.zip_with(head, tail, lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, v: a + v)
        spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n"), k.alias("k"), hi.alias("hi"), chi.alias("chi"), runs.alias("runs"), F.when(spread > 0, lag / spread).otherwise(1.0).alias("r"))

    def p_value(s: Column) -> Column:
        n, df, lo = s["n"], s["k"] - 1, s["n"] - s["hi"]
        # Wilson and Hilferty's cube root; the variance of a multinomial over n draws is smaller by (n - 1) / n
        v = 2 / (9 * df)
        p_chi = normal_tail((F.pow(s["chi"] / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))
        mu = 2 * s["hi"] * lo / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = F.when(var > 0, normal_tail((s["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
        p_serial = normal_tail((s["r"] + 1 / n) * F.sqrt(n))
        band = F.concat_ws(":", s["k"].cast("int"), F.floor(F.log2(n)))
        p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
        bin_ = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), band.alias("band"), bin_.alias("bin"))

    kept = F.filter(F.transform(tokens, encoded), lambda s: s["abc"].isNotNull())
    for stage in (symbols, moments, statistics, p_value):
        kept = F.transform(kept, stage)
    return kept


def tested(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,band:string,bin:int>>")
    return F.when(text.rlike(TOKEN), battery(located(text, TOKEN))).otherwise(none)


def style(text: Column) -> Column:
    """The way in which the text's words are run together."""
    return F.pmod(F.xxhash64(text), F.lit(STYLES)).cast("int")


def decoys(text: Column) -> Column:
    """As ``tested``, of words run together: as many tokens, of the same lengths. A text without words has none."""
    none = F.array().cast("array<struct<start:int,end:int,band:string,bin:int>>")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    way = style(text)
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 15)))
    joined = (
        F.when(way == 0, F.array_join(F.transform(words, F.lower), "")).when(way == 1, F.array_join(F.transform(words, capital), ""))
        .when(way == 2, F.array_join(words, "_")).otherwise(F.array_join(F.transform(words, lambda w, i: F.concat(F.lower(w), (i * 37 % 100).cast("string"))), ""))
    )

    def cut(pool: Column, s: Column, i: Column) -> Column:
        n = F.length(s["tok"])
        long = F.when(F.length(pool) < n, F.repeat(pool, F.ceil(n / F.length(pool)).cast("int"))).otherwise(pool)
        at = F.pmod(F.xxhash64(s["tok"], i), F.length(long) - n + 1) + 1
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(long, at.cast("int"), n).alias("tok"))

    held = F.transform(F.array(F.struct(joined.alias("pool"), located(text, TOKEN).alias("found"))), lambda x: F.transform(x["found"], lambda s, i: cut(x["pool"], s, i)))[0]
    return F.when(text.rlike(TOKEN) & text.rlike(WORD), battery(held)).otherwise(none)


def histograms(docs: DataFrame, text_col: str = "text") -> list[dict[str, dict[int, int]]]:
    """Numbers of tokens, and of the decoys of each style, by band and bin, over all rows.

    A band's tokens number at most those of the corpus, but only one row for each band
    and bin (at most 5 x 4 x 32 x 401) reaches the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda kind, found: F.transform(found, lambda t: F.struct(kind.alias("kind"), t["band"].alias("band"), t["bin"].alias("bin")))
    rows = docs.select(F.explode(F.concat(of(F.lit(0), tested(text)), of(style(text) + 1, decoys(text)))).alias("t")).groupBy("t.kind", "t.band", "t.bin").count().collect()
    out: list[dict[str, dict[int, int]]] = [{} for _ in range(STYLES + 1)]
    for kind, band, b, n in rows:
        out[kind].setdefault(band, {})[b] = n
    return out


def _structured(bins: dict[int, int], q: float) -> int:
    """The smallest bin that Benjamini-Hochberg rejects as structured."""
    m, seen, cut = sum(bins.values()), 0, BINS + 1
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if 10 ** (-b / BINS_PER_DECADE) <= seen * q / m:
            cut = b
    return cut


def _trusted(bins: dict[int, int], false: list[dict[int, int]], q: float) -> int:
    """The largest bin under which the estimated share of false reports is ``q`` at most; ``false``: decoys by style."""
    false = [f for f in false if f]
    if not false:
        return BINS + 1
    counts = [sum(f.values()) for f in false]
    total = sum(bins.values())
    low = lambda x, n: sum(c for b, c in x.items() if b >= RARE) / n
    # the share of tokens that are structured: all, where the decoys of some style are not rare enough to tell
    rare = min(low(f, n) for f, n in zip(false, counts, strict=True))
    share = min(1.0, low(bins, total) / rare) if rare else 1.0
    cut = tokens = 0
    wrong = [0] * len(false)
    for b in range(BINS + 1):
        tokens += bins.get(b, 0)
        wrong = [w + f.get(b, 0) for w, f in zip(wrong, false, strict=True)]
        if share * max(w / n for w, n in zip(wrong, counts, strict=True)) <= q * tokens / total:
            cut = b + 1
    return cut


def rejection_cuts(docs: DataFrame, text_col: str = "text", q: float = 0.05) -> dict[str, int]:
    """For each band the smallest bin that is rejected as structured, over all rows."""
    return {band: _structured(bins, q) for band, bins in histograms(docs, text_col)[0].items()}


def report_cuts(docs: DataFrame, text_col: str = "text", q: float = 0.05) -> dict[str, int]:
    """For each band the smallest bin that is not reported: rejected, or beyond what its decoys allow."""
    tokens, *false = histograms(docs, text_col)
    return {band: min(_structured(bins, q), _trusted(bins, [f.get(band, {}) for f in false], q)) for band, bins in tokens.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """One row per input row: id, array<struct<start, kind, end>> base and random."""
    cuts = report_cuts(docs, text_col, q)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    limit = F.map_from_arrays(F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts.values()))) if cuts else F.lit(None).cast("map<string,int>")
    passed = F.filter(F.col("__t"), lambda s: F.coalesce(s["bin"] < F.element_at(F.col("__cut"), s["band"]), F.lit(False)))

    def ranked(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    found = docs.select(
        F.col(id_col).alias(id_col), F.concat(*[ranked(k, s) for k, s in base.items()]).alias("base"), tested(text).alias("__t"), limit.alias("__cut")
    )
    return found.select(id_col, F.array_sort("base").alias("base"), ranked("random", passed).alias("random"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
