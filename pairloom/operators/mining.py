"""Hard negatives, difficulty, curriculum, schedules, ring buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .losses import batch_sims, unit
from .ordinal import seeded, with_ordinal
from .vectors import top_k


def hard_negatives(queries: DataFrame, keys: DataFrame, n: int, q_id: str, k_id: str, vector: str) -> DataFrame:
    """The n most similar keys of each query but the one with its own id."""
    return top_k(queries, keys, n, q_id, k_id, vector, exclude_self=True)


def difficulty(pairs: DataFrame) -> DataFrame:
    """batch, i, score = own similarity minus the hardest negative's within the batch (1.0 without negatives)."""
    s = batch_sims(unit(pairs)).groupBy("batch", "i").agg(
        F.max(F.when(F.col("i") == F.col("j"), F.col("sim"))).alias("own"), F.max(F.when(F.col("i") != F.col("j"), F.col("sim"))).alias("neg")
    )
    return s.select("batch", "i", F.round(F.when(F.col("neg").isNull(), 1.0).otherwise(F.col("own") - F.col("neg")), 6).alias("score"))


def curriculum_ratio(epoch: Column, epochs: int, kind: str) -> Column:
    """Share of the data that an epoch (from 0) sees: linear, sqrt, step, or all."""
    p = (epoch + 1) / F.lit(float(epochs))
    if kind == "linear":
        return p
    if kind == "sqrt":
        return F.sqrt(p)
    if kind == "step":
        return F.least(F.lit(1.0), (F.floor(epoch / 3) + 1) * 0.25)
    return F.lit(1.0)


def curriculum_prefix(scored: DataFrame, ratio: float, id_col: str, score: str, easy_first: bool = True, seed: int = 42) -> DataFrame:
    """The first max(1, floor(n * ratio)) rows by difficulty, with a seeded shuffle key.

    A high score is easy; ``easy_first=False`` takes the hardest rows first.
    """
    order = F.desc(score) if easy_first else F.asc(score)
    placed = with_ordinal(scored, order, id_col)
    cut = scored.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("__cut"))
    out = placed.join(F.broadcast(cut)).where(F.col("ordinal") < F.col("__cut")).drop("__cut")  # one row
    return out.withColumn("shuffle_key", seeded(seed, F.col(id_col).cast("string")))


def ring_buffer(df: DataFrame, order: str, capacity: int) -> DataFrame:
    """The last ``capacity`` rows by order, with the slot each one takes in a ring filled in that order."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    # at most ``capacity`` rows reach the window
    last = df.orderBy(F.desc(order)).limit(capacity).withColumn("__back", F.row_number().over(Window.orderBy(F.desc(order))))
    kept = last.join(F.broadcast(n)).withColumn("position", F.col("__n") - F.col("__back")).drop("__n", "__back")  # one row
    return kept.withColumn("slot", F.col("position") % capacity)


def temperature(epoch: Column, epochs: int, start: float = 0.05, least: float = 0.02) -> Column:
    return F.greatest(F.lit(least), start * (1 - epoch / F.lit(float(epochs))))


def learning_rate(step: Column, total: int, base: float = 2e-5, warm_share: float = 0.1) -> Column:
    """Linear warm-up over floor(total * share) steps, then half a cosine to zero."""
    warm = int(total * warm_share)
    progress = (step - warm) / F.lit(float(max(1, total - warm)))
    return F.when(step < warm, base * step / F.lit(float(max(1, warm)))).otherwise(F.greatest(F.lit(0.0), base * 0.5 * (1 + F.cos(F.pi() * progress))))


def effective_steps(batches: int, epochs: int, accumulation: int) -> int:
    return batches * epochs // accumulation


def adapter_targets(spark: SparkSession, layers: int, last: int, modules: tuple[str, ...]) -> DataFrame:
    """Names of the modules of the last layers: layer, module, name."""
    rows = spark.range(max(0, layers - last), layers).select(F.col("id").alias("layer"), F.explode(F.array(*map(F.lit, modules))).alias("module"))
    group = F.when(F.col("module").isin("gate_proj", "up_proj", "down_proj"), "mlp").otherwise("self_attn")
    return rows.withColumn("name", F.concat(F.lit("model.layers."), "layer", F.lit("."), group, F.lit("."), "module"))


#: Fixed values: (stage, epochs, batch size, learning rate, temperature, hard negatives)
STAGES = ((1, 3, 64, 1e-5, 0.1, 0), (2, 5, 32, 2e-5, 0.05, 5), (3, 2, 16, 5e-6, 0.02, 0))


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage int, epochs int, batch_size int, learning_rate double, temperature double, hard_negatives int")


def pairs_by_ratio(df: DataFrame, negatives: DataFrame, id_col: str, ratio: float) -> DataFrame:
    """Pairs per row: one positive and one negative if int(ratio) is 1, else one positive and two negatives.

    negatives: id, partner, attempt (see integrate.negative_pairs); the second negative swaps sides.
    """
    kinds = ["positive", "negative"] if int(ratio) == 1 else ["positive", "negative", "swapped"]
    rows = df.select(F.col(id_col).alias("id")).join(negatives.select("id", "partner"), "id", "left")
    rows = rows.select("id", "partner", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).where("kind = 'positive' or partner is not null")
    left = F.when(F.col("kind") == "swapped", F.col("partner")).otherwise(F.col("id"))
    right = F.when(F.col("kind") == "negative", F.col("partner")).otherwise(F.col("id"))
    return rows.select("id", "kind", left.alias("asm_id"), right.alias("src_id"), (F.col("kind") == "positive").cast("int").alias("label"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
