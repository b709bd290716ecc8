"""Exact dedup: stateful streaming deduplication.

Rows are first put into a content store, which gives each a locator (batch, position) and
holds its digest and normalised text. A stream reads the store's narrow columns in
micro-batches into keyed state that lives on disk (RocksDB) and never expires: for each
digest the stable identifier of the row that stays, the locator of its content and the
number of rows seen. Rows that hit an entry are then fetched from the store by their
locators, as is the entry's content, and compared byte for byte; the rows of a digest are
dealt to as many pieces as their number asks for, each with a copy of the entry's content.

Given a folder of its own, the store outlives the call: a second call over further rows
continues the state, and its rows are judged against all rows so far. Where calls bring
rows with a larger id, the verdict on earlier rows changes; a result tells what stays of
its own rows at its time. Each call has a number, from the caller or else from the rows
themselves. Its content enters the store whole, by one rename, and only once: a call that
is repeated, after a failure at any point or just so, counts its rows once and judges the
content that is there.

Defined results: a null text counts as empty; a null id ranks below every other id;
of rows that share id and text exactly one stays; an empty table gives an empty result;
columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, pick_rows, row_key, settings, split_count

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: rows of a group that are compared with one copy of the kept row
PIECE = 2_000


def state_settings(spark: SparkSession, partitions: int | None = None) -> dict[str, str]:
    """RocksDB stores, fewer than shuffle partitions: each reserves 4 MB of disk however
    little it holds, and a digest's entry is a hundredth of its document."""
    n = partitions or max(8, -(-split_count(spark) // 8))
    return {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.internal.stateStore.partitions": str(n),
    }


def keyed_state(feed: DataFrame) -> DataFrame:
    """The stateful operator; ``feed`` (streaming or not) has digest, id, batch, at.

    Sums are built before the shuffle, so a digest that a third of all rows share costs
    one row from each task. Without a watermark the state has no expiry.
    """
    return feed.groupBy("digest").agg(F.max(F.struct("id", "batch", "at")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 256 << 30, digest: Column | None = None, state_partitions: int | None = None, store: str | None = None, batch: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``store`` is a folder that all executors reach, for the content and the state of
    several calls (a scratch folder if not given; calls of one store follow one another).
    ``batch`` names a call of a store, so that it can be repeated; calls with other rows need
    another number. Without it, equal rows are taken for a repeated call.
    ``batch_bytes`` bounds a micro-batch (bytes of content files); ``state_partitions`` is
    the number of state stores (an eighth of the shuffle partitions, 8 at least, if not
    given; a store keeps its first number).
    ``digest`` replaces SHA-256 of column ``norm`` (tests use a short one to force hits
    with different bytes). Such rows leave the group and form groups by their own text.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "exact-dedup")
    root = (store or tmp.path("store")).rstrip("/")
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    if batch is None:
        batch = _number(norm) if store else 0
    rows = norm.select(
        "id", F.monotonically_increasing_id().alias("at"), F.sha2("norm", 256).alias("text_sha256"),
        (F.unhex(F.sha2("norm", 256)) if digest is None else digest).alias("digest"), "norm", F.lit(batch).cast("long").alias("batch"),
    )
    _enter(rows, root, batch)
    content = spark.read.schema(rows.schema).parquet(f"{root}/content")
    narrow = content.drop("norm")

    with settings(spark, state_settings(spark, state_partitions)):
        feed = narrow.select("id", "batch", "at", "digest")
        # content counts however old it is when a call is repeated
        stream = spark.readStream.schema(feed.schema).options(maxBytesPerTrigger=str(batch_bytes), maxFileAge="36500d").parquet(f"{root}/content")
        query = (
            keyed_state(stream).writeStream.outputMode("update").format("noop").trigger(availableNow=True)
            .option("checkpointLocation", f"{root}/state").start()
        )
        query.awaitTermination()
        fields = keyed_state(feed).schema
        state = spark.read.format("statestore").load(f"{root}/state").select("key.*", "value.*").toDF(*fields.names)
        if store:
            state = state.join(narrow.where(F.col("batch") == batch).select("digest").distinct(), "digest", "left_semi")
        state = tmp.save(state.select("digest", F.col("keeper.id").alias("keep_id"), F.struct("keeper.batch", "keeper.at").alias("keep_at"), "group_size"), "kept")

    judged = tmp.save(narrow.join(state, "digest"), "judged")
    judged = _regrouped(judged, _unequal(content, judged, tmp))
    kept = (F.col("batch") == F.col("keep_at.batch")) & (F.col("at") == F.col("keep_at.at"))
    return judged.where(F.col("batch") == batch).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _number(norm: DataFrame) -> int:
    """A number for the rows of a call, the same in any order and split."""
    r = norm.agg(F.sum(F.xxhash64("id", "norm").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return (int(r.s or 0) * 1_000_003 + r.n) % (1 << 62)


def _enter(rows: DataFrame, root: str, batch: int) -> None:
    """Puts a call's content into the store, unless it is there."""
    jvm = rows.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/content/batch={batch}")
    fs = target.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(target):
        return
    rows.drop("batch").write.mode("overwrite").parquet(f"{root}/entering/{batch}")
    fs.mkdirs(target.getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{root}/entering/{batch}"), target):
        raise OSError(f"{root}/entering/{batch} could not be moved into the store")


def _unequal(content: DataFrame, judged: DataFrame, tmp: Scratch) -> DataFrame:
    """Digests of which some hit differs from the kept row in bytes: digest.

    Every row of a group is fetched once by its locator; a piece of a group has at most
    about ``PIECE`` rows, and each piece a copy of the kept row.
    """
    keeper = (F.col("batch") == F.col("keep_at.batch")) & (F.col("at") == F.col("keep_at.at"))
    pieces = F.ceil(F.col("group_size") / PIECE).cast("int")
    asked = judged.where("group_size > 1").select("batch", "at", "digest", keeper.alias("keeper"), pieces.alias("pieces"), F.pmod(F.xxhash64("batch", "at"), pieces).alias("piece"))
    fetched = tmp.save(content.select("batch", "at", "norm").join(asked, ["batch", "at"]), "fetched")
    keepers = fetched.where("keeper").select("digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("norm").alias("kept_norm"))
    hits = fetched.where("not keeper").select("digest", F.col("piece").cast("int").alias("piece"), "norm")
    return tmp.save(hits.join(keepers, ["digest", "piece"]).where("norm <> kept_norm").select("digest"), "unequal").distinct()


def _regrouped(judged: DataFrame, odd: DataFrame) -> DataFrame:
    """Rows of digests with unequal bytes are grouped by whole-text SHA-256 instead."""
    if odd.isEmpty():
        return judged
    own = judged.join(odd, "digest", "left_semi")
    by_text = own.groupBy("digest", "text_sha256").agg(F.max(F.struct("id", "batch", "at")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    by_text = by_text.select("digest", "text_sha256", F.col("k.id").alias("keep_id"), F.struct("k.batch", "k.at").alias("keep_at"), "group_size")
    own = own.drop("keep_id", "keep_at", "group_size").join(by_text, ["digest", "text_sha256"])
    return judged.join(odd, "digest", "left_anti").unionByName(own)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(row_key(F.col(id_col), F.col("text_sha256")).alias("key"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return pick_rows(docs, row_key(F.col(id_col), sha), kept)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir, "doc_id", "text"))


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
