"""The driver's tables laid out as scans.

P: an embedding is an 8 x 8 pattern, and vectors lie in rows of 25. L: a part's quantities by ship year and line number, 7 x 7.
E: a user's values by hour and type of event, 24 x 5. D: of P, every fourth vector is experimental and the rest a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, P_SHAPE, L_SHAPE, E_SHAPE = 25, (8, 8), (7, 7), (24, 5)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: idx, y, x, phase_id, pixels."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), F.col("label").alias("phase_id"), F.col("embedding").cast("array<double>").alias("pixels"))


def _dense(cells: DataFrame, n: int) -> DataFrame:
    """idx, pixels from idx, pixel, v with zeros where a pixel is absent."""
    maps = cells.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("pixel", "v"))).alias("m"))
    return maps.select("idx", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("pixels"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: idx, pixels."""
    li = table(spark, sf_dir, "lineitem")
    pixel = (F.year("l_shipdate") - 1995) * 7 + F.col("l_linenumber") - 1
    cells = li.select(F.col("l_partkey").alias("idx"), pixel.cast("int").alias("pixel"), "l_quantity").groupBy("idx", "pixel").agg(F.sum("l_quantity").alias("v"))
    return _dense(cells, 49)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: idx, pixels."""
    ev = table(spark, sf_dir, "events")
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    cells = ev.select(F.col("user_id").alias("idx"), (F.hour(F.col("ts").cast("timestamp_ntz")) * 5 + kind).cast("int").alias("pixel"), "value").groupBy("idx", "pixel").agg(F.sum("value").alias("v"))
    return _dense(cells, 120)


def experimental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: the vectors with ids divisible by 4, in rows of 25."""
    e = F.col("idx") / 4
    return patterns(spark, sf_dir).filter("idx % 4 = 0").withColumns({"y": F.floor(e / WIDTH).cast("int"), "x": (e.cast("bigint") % WIDTH).cast("int")})


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: sim_idx, phase_id, pixels of the others."""
    return patterns(spark, sf_dir).filter("idx % 4 <> 0").select(F.col("idx").alias("sim_idx"), "phase_id", "pixels")


def projection_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection centre for each point of P: idx, y, x, pcx, pcy, pcz."""
    return patterns(spark, sf_dir).select("idx", "y", "x", (F.lit(0.4) + F.col("x") / 1000.0).alias("pcx"), (F.lit(0.7) - F.col("y") / 500.0).alias("pcy"), (F.lit(0.5) + F.col("y") / 800.0 + F.col("x") / 9000.0).alias("pcz"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bunge angles for each point of P: idx, phi1, Phi, phi2."""
    return patterns(spark, sf_dir).select("idx", (F.col("idx") * 0.013).alias("phi1"), (F.col("y") * 0.07 + 0.1).alias("Phi"), (F.col("x") * 0.21).alias("phi2"))


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long(df: DataFrame, *keys: str, column: str = "pixels", name: str = "v") -> DataFrame:
    """One row per pixel: the keys, pixel, v."""
    return df.select(*keys, F.posexplode(column).alias("pixel", "_v")).select(*keys, "pixel", r6("_v").alias(name))
