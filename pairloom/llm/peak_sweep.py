"""Peak concurrency sweep over intervals in groups: how many are open, worth how much, and when most.

Starts and ends become differences by group and slot of the time grain. They are summed
before they are shuffled, so a group or slot that holds a third of all rows costs a row a
task. Slots are gathered by group and chunk of ``chunk_slots`` slots. Each chunk is a row of a
dense difference array that bincount fills; its cumulative sums give its totals and
maxima. Totals are carried from chunk to chunk in three levels (chunks by the 64, those by
the 64, the rest of a group: about 11 years of a minute's grain to a row there), so no
window holds more than 64 rows of the first two levels, and the last a bounded number for
the whole range of timestamps. A second pass over the arrays adds what was carried and
emits the slots at which something changes.

Sums are 64-bit integers throughout: bincount sums 24-bit pieces of each number, which is
exact for up to 2**29 differences of a slot.

Defined results: intervals without start, or whose end is not after their start (in
slots), take no part; without end they stay open; a null weight counts as 0, and so does
one that is no finite number; a null group is a group of its own (null); equal intervals
count each; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: seconds of a slot
GRAIN = 60
#: slots of a chunk; a chunk's arrays take 50 kB
CHUNK_SLOTS = 1440
#: chunks whose dense arrays are held at a time
ROWS = 128
FAN = 6
WEEK = 7 * 86400


def utc_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down; a timestamp without zone is taken as UTC."""
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def differences(intervals: DataFrame, grain: int = GRAIN, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """``grp, chunk`` and its slots (slot, dn, dw) at which the number or the weight changes.

    ``intervals``: grp, lo, hi (seconds; hi null: never ends), w (long).
    """
    span = grain * chunk_slots
    slots = intervals.withColumns({"lo": F.floor(F.col("lo") / grain), "hi": F.floor(F.col("hi") / grain)})
    whole = slots.where(F.col("lo").isNotNull() & (F.col("hi").isNull() | (F.col("hi") > F.col("lo"))))
    w = F.coalesce("w", F.lit(0))
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("n"), w.alias("w")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("n"), (-w).alias("w")))
    events = whole.select("grp", F.inline(ends)).where("at IS NOT NULL")
    chunk = F.floor(F.col("at") / chunk_slots)
    summed = events.groupBy("grp", chunk.alias("chunk"), (F.col("at") - chunk * chunk_slots).cast("int").alias("slot")).agg(F.sum("n").alias("dn"), F.sum("w").alias("dw"))
    return summed.where("dn <> 0 OR dw <> 0").groupBy("grp", "chunk").agg(F.collect_list(F.struct("slot", "dn", "dw")).alias("slots"))


def _bincount(at: np.ndarray, amount: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of 64-bit integers by index."""
    out = np.zeros(size, np.int64)
    for shift in (0, 24, 48):
        part = (amount >> shift) & 0xFFFFFF if shift < 48 else amount >> shift
        if part.any():
            out += np.bincount(at, part, size).astype(np.int64) << shift
    return out


def _dense(batch: pa.RecordBatch, chunk_slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference arrays (a row a chunk, a column a slot) of the counts and weights, and which slots change."""
    slots = batch.column(batch.schema.get_field_index("slots"))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(slots.offsets.to_numpy()))
    flat = slots.flatten()
    at = owner * chunk_slots + flat.field(0).to_numpy()
    size = batch.num_rows * chunk_slots
    dn, dw = (_bincount(at, flat.field(k).to_numpy(), size).reshape(-1, chunk_slots) for k in (1, 2))
    return dn, dw, (dn != 0) | (dw != 0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def chunk_totals(diffs: DataFrame, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """Adds to each chunk its sums (tn, tw), the maxima of its running sums (mn, mw) and its first slot (first)."""
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            dn, dw, changes = _dense(b, chunk_slots)
            n, w = dn.cumsum(1), dw.cumsum(1)
            cols = [n[:, -1], w[:, -1], np.where(changes, n, low).max(1), np.where(changes, w, low).max(1), changes.argmax(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int64)) for c in cols)], [*b.schema.names, "tn", "tw", "mn", "mw", "first"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in diffs.schema)
    return diffs.mapInArrow(run, f"{schema}, tn long, tw long, mn long, mw long, first long")


def carried(totals: DataFrame, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """grp, chunk, and what earlier and later chunks of the group tell: n0, w0 (sums before),
    high0 (largest count before, null at the start), peak (largest weight of the group),
    next_at (slot number of the next change, null at the end).

    Each level sums up nodes of 64 by one window over their siblings, from chunks up; then
    the upper levels' results are handed down.
    """
    levels = [totals.select("grp", F.col("chunk").alias("node"), "tn", "tw", "mn", "mw", (F.col("chunk") * chunk_slots + F.col("first")).alias("at"))]
    scans = []
    for depth in range(3):
        up = F.shiftright("node", FAN) if depth < 2 else F.lit(0).cast("long")
        siblings = Window.partitionBy("grp", "up").orderBy("node")
        before = siblings.rowsBetween(Window.unboundedPreceding, -1)
        x = levels[-1].withColumn("up", up)
        x = x.withColumns({"n0": F.coalesce(F.sum("tn").over(before), F.lit(0)), "w0": F.coalesce(F.sum("tw").over(before), F.lit(0)), "next_at": F.lead("at").over(siblings)})
        x = x.withColumns({"mn": F.col("n0") + F.col("mn"), "mw": F.col("w0") + F.col("mw")}).withColumn("high0", F.max("mn").over(before))
        scans.append(x)
        levels.append(x.groupBy("grp", F.col("up").alias("node")).agg(F.sum("tn").alias("tn"), F.sum("tw").alias("tw"), F.max("mn").alias("mn"), F.max("mw").alias("mw"), F.min("at").alias("at")))
    peaks = levels[3].select("grp", F.col("mw").alias("peak"))
    down = None
    for x in reversed(scans):
        if down is None:
            y = x.select("*", F.lit(0).cast("long").alias("pn"), F.lit(0).cast("long").alias("pw"), F.lit(None).cast("long").alias("ph"), F.lit(None).cast("long").alias("pa"))
        else:
            d = down.select(F.col("grp").alias("d_grp"), F.col("node").alias("d_up"), F.col("n0").alias("pn"), F.col("w0").alias("pw"), F.col("high0").alias("ph"), F.col("next_at").alias("pa"))
            y = x.join(d, F.col("grp").eqNullSafe(F.col("d_grp")) & (F.col("up") == F.col("d_up")))
        down = y.select(
            "grp", "node", (F.col("pn") + F.col("n0")).alias("n0"), (F.col("pw") + F.col("w0")).alias("w0"),
            F.greatest("ph", F.col("pn") + F.col("high0")).alias("high0"), F.coalesce("next_at", "pa").alias("next_at"),
        )
    p = peaks.withColumnRenamed("grp", "p_grp")
    return down.join(p, F.col("grp").eqNullSafe(F.col("p_grp"))).select("grp", F.col("node").alias("chunk"), "n0", "w0", "high0", "peak", "next_at")


def sweep(intervals: DataFrame, grain: int = GRAIN, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """A row for each group and moment at which the number of open intervals or their weight changes.

    ``intervals``: grp (int), lo and hi in seconds (hi, the first moment after, null: never
    ends), w (long). Returns grp, from_s, to_s (the next moment of the group, null at the
    last), n_open, open_weight, high_open (largest n_open so far), is_peak (open_weight is
    the group's largest).
    """
    tmp = Scratch(intervals.sparkSession, "sweep")
    totals = tmp.save(chunk_totals(differences(intervals, grain, chunk_slots), chunk_slots), "chunks")
    c = tmp.save(carried(totals.drop("slots"), chunk_slots), "carried")
    c = c.withColumnsRenamed({"grp": "c_grp", "chunk": "c_chunk"})
    both = totals.select("grp", "chunk", "slots").join(c, F.col("grp").eqNullSafe(F.col("c_grp")) & (F.col("chunk") == F.col("c_chunk"))).drop("c_grp", "c_chunk")
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            dn, dw, changes = _dense(b, chunk_slots)
            col = lambda name, null: b.column(name).fill_null(null).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            n = dn.cumsum(1) + col("n0", 0)[:, None]
            w = dw.cumsum(1) + col("w0", 0)[:, None]
            high = np.maximum(np.maximum.accumulate(np.where(changes, n, low), 1), col("high0", low)[:, None])
            row, slot = np.nonzero(changes)
            at = col("chunk", 0)[row] * chunk_slots + slot
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
            following = np.where(last, col("next_at", 0)[row], np.append(at[1:], 0))
            ends = last & b.column("next_at").is_null().to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays(
                [b.column("grp").take(pa.array(row)), pa.array(at * grain), pa.array(following * grain, mask=ends), pa.array(n[changes]), pa.array(w[changes]), pa.array(high[changes]), pa.array(w[changes] == col("peak", 0)[row])],
                ["grp", "from_s", "to_s", "n_open", "open_weight", "high_open", "is_peak"],
            )

    return both.mapInArrow(run, f"grp {dict(intervals.dtypes)['grp']}, from_s long, to_s long, n_open long, open_weight long, high_open long, is_peak boolean")


def op11_peak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales by the nation of their client, and of all nations (-2), by the minute."""
    tmp = Scratch(spark, "open-sales")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # written, so that both sides of the joins below are plain shuffles that a hot key can be split in
    shipped = tmp.save(read("sale_lines").groupBy("sale_id").agg((utc_seconds(F.min("shipped_at")) + WEEK).alias("hi")).where("hi IS NOT NULL"), "shipped")
    nations = tmp.save(read("clients").where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "nations")
    cents = F.floor(F.lit(100.0) * F.col("total") + 0.5).cast("long")
    finite = F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < 9e16)
    sales = read("sales").where("sold_at IS NOT NULL").select("sale_id", "client_id", utc_seconds(F.col("sold_at")).alias("lo"), F.when(finite, cents).otherwise(0).alias("w"))
    open_ = sales.join(shipped, "sale_id", "left").join(nations, "client_id", "left")
    intervals = open_.select(F.explode(F.array(F.coalesce("nation_id", F.lit(-1)), F.lit(-2))).alias("grp"), "lo", "hi", "w")
    return sweep(intervals).withColumnsRenamed({"grp": "nation_id", "open_weight": "open_cents"})


OP11_SQL = """
WITH s AS (SELECT sale_id, min(shipped_at) AS at FROM sale_lines GROUP BY sale_id),
c AS (SELECT client_id, min(nation_id) AS nation_id FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
o AS (SELECT coalesce(c.nation_id, -1) AS nation_id, epoch_us(sold_at) // 60000000 * 60 - CASE WHEN epoch_us(sold_at) % 60000000 < 0 THEN 60 ELSE 0 END AS lo,
  epoch_us(s.at) // 60000000 * 60 - CASE WHEN epoch_us(s.at) % 60000000 < 0 THEN 60 ELSE 0 END + 604800 AS hi, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS w
 FROM sales LEFT JOIN s ON s.sale_id = sales.sale_id LEFT JOIN c ON c.client_id = sales.client_id WHERE sold_at IS NOT NULL),
i AS (SELECT * FROM o WHERE hi IS NULL OR hi > lo),
g AS (SELECT * FROM i UNION ALL SELECT -2, lo, hi, w FROM i),
e AS (SELECT nation_id, lo AS t, 1 AS n, w FROM g UNION ALL SELECT nation_id, hi, -1, -w FROM g WHERE hi IS NOT NULL),
d AS (SELECT nation_id, t, sum(n) AS dn, sum(w) AS dw FROM e GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(w) <> 0),
r AS (SELECT nation_id, t, lead(t) OVER v AS to_s, (sum(dn) OVER v)::BIGINT AS n_open, (sum(dw) OVER v)::BIGINT AS open_cents FROM d WINDOW v AS (PARTITION BY nation_id ORDER BY t))
SELECT nation_id::INT AS nation_id, t::BIGINT AS from_s, to_s::BIGINT AS to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY t) AS high_open,
 open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak FROM r
"""
