"""Mixing sources to target weights by capped water-filling, with seeded repetition.

The budget is shared among the sources in proportion to their weights, but a source gives at most
`max_epochs` times what it has; what a clamped source leaves over goes to the others in proportion to
their weights, and so on until nobody is above the cap.  The level at which that ends is found in
closed form: with sources in rising order of cap / weight, it is the first running level that is
feasible.  Each document then comes floor(epochs) times, and once more with the chance of the rest,
drawn from a hash of the seed and its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh

MAX_EPOCHS, POWER, SEED = 4.0, 0.5, 2024
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle with the sources salted.
BROADCAST_SOURCES = 50_000
SALT = 64


def source_sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size): characters of each source's texts; a null text has none, null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.char_length(text_col)), F.lit(0)).cast("long").alias("size"))


def water_fill(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, power: float = POWER, budget: int | None = None) -> DataFrame:
    """(source, size, weight, epochs): how often each source is to be read.

    `sizes` has source and size, and weight if the weights are given (null or negative counts as 0);
    otherwise a source weighs size ** power.  The budget is the total size unless given; where even
    max_epochs of all sources with weight fall short of it, they all get max_epochs.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) if "weight" in sizes.columns else F.pow(F.col("size").cast("double"), F.lit(float(power)))
    s = sizes.select("source", F.col("size").cast("long").alias("size"), weight.alias("weight")).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    # one row a source: small beside the corpus, so one task may order them
    live = s.where("size > 0 and weight > 0")
    everyone = Window.partitionBy(F.lit(0))
    upward = everyone.orderBy(F.col("cap") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(budget)) if budget is not None else F.col("all").cast("double")
    live = live.crossJoin(s.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")))
    live = live.withColumn("used", F.coalesce(F.sum("cap").over(upward), F.lit(0.0))).withColumn("rest", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upward), F.lit(0.0)))
    live = live.withColumn("level", (total - F.col("used")) / F.col("rest"))
    # the first source that its level doesn't drown sets the level; those before it are clamped
    feasible = live.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everyone)["level"])
    epochs = F.when(F.col("level").isNull(), F.lit(float(max_epochs))).otherwise(F.least(F.lit(float(max_epochs)), F.greatest(F.lit(0.0), F.col("level") * F.col("weight") / F.col("size"))))
    found = feasible.select(F.col("source").alias("filled"), epochs.alias("epochs"))
    return s.join(found, F.col("source").eqNullSafe(F.col("filled")), "left").select("source", "size", "weight", F.round(F.coalesce("epochs", F.lit(0.0)), 9).alias("epochs"))


def _draw(id_col: str, seed: int):
    """A number from 0 to 1 that depends on seed and id alone, the same in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, epochs: DataFrame, copy_col: str = "copy", id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The documents, each as many times as its source's epochs say, numbered from 0 in `copy_col`.

    Repeated rows with the same id are drawn alike; a source that `epochs` doesn't know is left out.
    """
    rate, of = fresh(docs, "epochs_of_source"), fresh(docs, "source_of_epochs")
    known = epochs.select(F.col("source").alias(of), F.col("epochs").alias(rate))
    if known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(known), docs[source_col].eqNullSafe(F.col(of)))
    else:
        salt = fresh(docs, "salt")
        salted = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        left = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int"))
        joined = left.join(salted, left[source_col].eqNullSafe(F.col(of)) & (left[salt] == salted[salt])).drop(salt)
    times = (F.floor(rate) + F.when(_draw(id_col, seed) < F.col(rate) - F.floor(rate), F.lit(1)).otherwise(F.lit(0))).cast("int")
    repeated = joined.withColumn(rate, times).where(F.col(rate) > 0)
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(rate) - 1)).alias(copy_col))


def mix_documents(docs: DataFrame, max_epochs: float = MAX_EPOCHS, power: float = POWER, seed: int = SEED, copy_col: str = "copy") -> DataFrame:
    """Water-filling over the sizes found in `docs`, and the sampled documents."""
    from graphloom.llm.common import cut

    # an empty table has no sources; they are computed once, then read by the count and by the join
    return mix(docs, cut(water_fill(cut(source_sizes(docs)), max_epochs, power)), copy_col, seed=seed)


SQL = f"""
WITH s AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(CAST(size AS DOUBLE), {POWER}) AS weight, size * CAST({MAX_EPOCHS} AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (SELECT CAST(sum(size) AS DOUBLE) FROM s) AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest
  FROM w WHERE size > 0),
f AS (SELECT arg_min((budget - used) / rest, row(cap / weight, source)) AS level FROM l WHERE (budget - used) / rest * weight <= cap),
e AS (SELECT source, round(CASE WHEN level IS NULL THEN CAST({MAX_EPOCHS} AS DOUBLE) ELSE least(CAST({MAX_EPOCHS} AS DOUBLE), greatest(0.0, level * weight / size)) END, 9) AS epochs FROM l, f),
d AS (SELECT doc_id, d.source, n_chars, CAST(floor(epochs) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 < epochs - floor(epochs) THEN 1 ELSE 0 END AS times
  FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, n_chars, CAST(unnest(range(times)) AS INTEGER) AS copy FROM d WHERE times > 0
"""
