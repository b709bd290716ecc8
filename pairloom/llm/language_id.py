"""Language ID by error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier on hashed character
n-grams tells the languages with that bit set from the others. Decoding adds up, over the
bits, the logistic loss of a language's bit, weighted by how well the bit's classifier
knows that language, and takes the language of least loss. If the runner-up is close, the
document is flagged ambiguous.

Training takes at most ``rows_per_lang`` documents a language, of at most ``sample_bytes``
bytes each (documented bounds on what reaches the driver; which rows is decided by a hash
of the id). A language that has longer labelled texts only is learned from ``sample_bytes``
characters at most out of the middle of each. Prediction reads every whole text and only the text. Model and code are a few
hundred kB whatever the corpus.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if nothing
was learned; with one learned language that one with score 1; a null id is not held out
and never learned from; a null language is not learned from; repeated rows are judged
alike; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, trimmed

BUCKETS = 4096
SHIFT = np.uint32(20)
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space; other bytes stay
FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the lower-cased bytes."""
    raw = np.frombuffer(b" " + text.lower().encode(errors="replace").translate(FOLD) + b" ", np.uint8)
    total = np.zeros(BUCKETS)
    for at in range(0, len(raw), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        one = b[: 1 << 20]
        pair = b[: (1 << 20) + 1]
        two = pair[:-1] * np.uint32(257) + pair[1:] + np.uint32(1 << 17)
        for gram, solid in ((one, one != 32), (two, (pair[:-1] != 32) | (pair[1:] != 32))):
            total += np.bincount((gram[solid] * np.uint32(2654435769)) >> SHIFT, minlength=BUCKETS)
        if len(b) > 2:
            three = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
            solid = (b[:-2] != 32) | (b[1:-1] != 32)
            total += np.bincount((three[solid] * np.uint32(2246822519)) >> SHIFT, minlength=BUCKETS)
    n = total.sum()
    return np.sqrt(total / n) if n else total


def codewords(langs: int, bits: int | None = None, seed: int = 0) -> np.ndarray:
    """(langs, bits) of +1 and -1. Up to 7 languages: all splits; else random splits far apart."""
    if langs <= 7 and bits is None:
        splits = np.arange(1, 1 << (langs - 1))
        return np.where((splits[None, :] >> np.arange(langs)[:, None]) & 1, 1, -1) if langs > 1 else np.ones((1, 1), int)
    bits = bits or int(np.ceil(10 * np.log2(langs)))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (langs, bits))
        code[:, np.abs(code.sum(0)) == langs] *= np.where(np.arange(langs) % 2, 1, -1)[:, None]
        d = (bits - code @ code.T) // 2
        least = int(d[~np.eye(langs, dtype=bool)].min())
        if least > far:
            best, far = code, least
    return best


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows, langs) and the loss margin between the best two."""
        f = x @ self.weights + self.bias
        z = self.code[None] * f[:, None, :]
        loss = (np.logaddexp(0, -z) * self.trust[None]).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        two = np.sort(loss, 1)[:, :2]
        return p / p.sum(1, keepdims=True), (two[:, 1] - two[:, 0]) if loss.shape[1] > 1 else np.full(len(x), np.inf)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 100, ridge: float = 1e-4) -> Model:
    """Logistic regressions for all bits at once, by accelerated gradient descent; languages weigh alike."""
    code = codewords(len(langs))
    target = code[y].astype(np.float32)
    x = x.astype(np.float32)
    share = (1.0 / np.bincount(y, minlength=len(langs))[y] / len(langs)).astype(np.float32)[:, None]
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look, look_b, t = w.copy(), bias.copy(), 1.0
    rate = 2.0
    for _ in range(steps):
        g = -target * share / (1 + np.exp(target * (x @ look + look_b)))
        new, new_b = look - rate * (x.T @ g + ridge * look), look_b - rate * g.sum(0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - bias)
        w, bias, t = new, new_b, t_new
    right = (x @ w + bias) * target > 0
    trust = np.stack([right[y == k].mean(0) for k in range(len(langs))]).clip(1e-3)
    return Model(tuple(langs), code, w.astype(np.float32), bias, trust / trust.sum(1, keepdims=True))


def train(labelled: DataFrame, rows_per_lang: int = 750, sample_bytes: int = 8_000) -> Model | None:
    """``labelled``: id, text, lang. None if nothing can be learned."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.octet_length("text") <= sample_bytes
    sizes = usable.groupBy("lang").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("n")).collect()
    counts = {r.lang: r.short or r.n for r in sizes}
    rare = [r.lang for r in sizes if not r.short]
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - sample_bytes) / 2).cast("int")), F.lit(sample_bytes))
    usable = usable.where(short | F.col("lang").isin(rare)).withColumn("text", F.when(short, F.col("text")).otherwise(middle))
    if not counts:
        return None
    # about rows_per_lang rows of each language, by hash: no sort of texts
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, rows_per_lang / n)])
    sample = usable.where(draw < F.element_at(share, F.col("lang"))).select("id", "text", "lang").limit(2 * rows_per_lang * len(counts)).collect()
    sample = sorted((r for r in sample if LETTER.search(r.text)), key=lambda r: (r.id, r.text))
    langs = sorted({r.lang for r in sample})
    if not langs:
        return None
    x = np.stack([ngram_counts(r.text).astype(np.float32) for r in sample])
    return fit(x, np.array([langs.index(r.lang) for r in sample]), langs)


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, close: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = len(b)
        lang, score, margin = ["und"] * n, np.zeros(n), np.zeros(n)
        for at in range(0, n if model else 0, 512):
            rows = [(i, t) for i, t in enumerate(b.column("text")[at : at + 512].to_pylist(), at) if t and LETTER.search(t)]
            if rows:
                p, gap = model.decode(np.stack([ngram_counts(t) for _, t in rows]))
                best = p.argmax(1)
                for k, (i, _) in enumerate(rows):
                    lang[i], score[i], margin[i] = model.langs[best[k]], p[k, best[k]], gap[k]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("row"), pa.array(lang), pa.array(score), pa.array(margin), pa.array((margin < close) & (np.array(lang) != "und"))],
            names=["id", "row", "lang_pred", "score", "margin", "ambiguous"],
        )


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", close: float = 0.02) -> DataFrame:
    """One row per input row: id, row, lang_pred, score, margin, ambiguous (margin below ``close``)."""
    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(lambda it: trimmed(_predict(it, model, close)), f"id {kind}, row long, lang_pred string, score double, margin double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model | None:
    """Trains on the documents that are not held out."""
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return train(seen.select(F.col("doc_id").alias("id"), "text", "lang"))


def _identified(batches: Iterator[pa.RecordBatch], model: Model | None, close: float, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        none = pa.nulls(len(b), pa.int64())
        probe = pa.RecordBatch.from_arrays([none, none, b.column(at)], names=["id", "row", "text"])
        found = next(_predict(iter([probe]), model, close))
        good = np.array(found.column("lang_pred").to_pylist()) != "und"
        yield b.filter(pa.array(good & ~found.column("ambiguous").to_numpy(zero_copy_only=False)))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", close: float = 0.02) -> DataFrame:
    """The rows whose language is known and not ambiguous, with all their columns; one pass, no shuffle."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: trimmed(_identified(it, model, close, at)), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "margin")
