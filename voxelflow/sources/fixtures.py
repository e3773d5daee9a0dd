"""Volumes and polylines made from the star-schema tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A count volume of 50 x 11 x 9 cells; a cell without a row is 0.
GRID_SQL = "select cast(l_quantity as int) - 1 as z, cast(round(l_discount * 100) as int) as y, cast(round(l_tax * 100) as int) as x, cast(count(*) as int) as v from lineitem group by 1, 2, 3"
GRID_SHAPE = (50, 11, 9)
#: Volumes of that shape, one for each 6,000 order keys, so that their number grows with the table.
STACK_SQL = "select 's' || cast(l_orderkey // 6000 as varchar) as volume_id, cast(l_quantity as int) - 1 as z, cast(round(l_discount * 100) as int) as y, cast(round(l_tax * 100) as int) as x, cast(count(*) as int) as v from lineitem group by 1, 2, 3, 4"
#: A dense volume of signed integers, 25 x 20 x 64 cells for 500 vectors.
VEC_SQL = "select cast(floor(vec_id / 20) as int) as z, cast(vec_id % 20 as int) as y, cast(i - 1 as int) as x, cast(floor(cast(embedding[i] as double) * 1000) as int) as v from embeddings, range(1, 65) r(i)"
VEC_SIDES = (20, 64)
#: An ordered polyline for each user.
POLY_SQL = "select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as i, cast(hour(ts) as int) as z, cast(minute(ts) as int) as y, cast(floor(value / 10) as int) as x from events"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume_id, z, y, x, v): how many line items have a quantity, discount and tax."""
    cell = [F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")]
    counts = _table(spark, sf_dir, "lineitem").groupBy(*(c.alias(n) for c, n in zip(cell, "zyx", strict=True))).agg(F.count("*").cast("int").alias("v"))
    return counts.select(F.lit("grid").alias("volume_id"), "z", "y", "x", "v")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume_id, z, y, x, v): as `grid`, by 6,000 order keys."""
    cell = [F.concat(F.lit("s"), F.floor(F.col("l_orderkey") / 6000).cast("string")), F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")]
    return _table(spark, sf_dir, "lineitem").groupBy(*(c.alias(n) for c, n in zip(cell, ("volume_id", "z", "y", "x"), strict=True))).agg(F.count("*").cast("int").alias("v"))


def alike(names: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Volumes (volume_id, nz, ny, nx, sz, sy, sx) of one shape and cells of size 1."""
    return names.select("volume_id", *[F.lit(n).alias(f"n{a}") for n, a in zip(shape, "zyx", strict=True)], *[F.lit(1.0).alias(f"s{a}") for a in "zyx"])


def stack_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.floor(F.col("l_orderkey") / 6000).cast("string")).alias("volume_id")).distinct()
    return alike(names, GRID_SHAPE)


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume_id, z, y, x, v): each vector is a row of a slice of 20, its components in thousandths."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.lit("vec").alias("volume_id"), F.floor(F.col("vec_id") / 20).cast("int").alias("z"), (F.col("vec_id") % 20).cast("int").alias("y"), "x", F.floor(F.col("e").cast("double") * 1000).cast("int").alias("v"))


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, i, z, y, x): a user's events in order, by hour, minute and value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(order) - 1).cast("int").alias("i"), F.hour("ts").cast("int").alias("z"), F.minute("ts").cast("int").alias("y"), F.floor(F.col("value") / 10).cast("int").alias("x"))


def volume(spark: SparkSession, volume_id: str, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A row of the volume table: volume_id, nz, ny, nx, sz, sy, sx."""
    return spark.createDataFrame([(volume_id, *shape, *spacing)], "volume_id string, nz int, ny int, nx int, sz double, sy double, sx double")


def grid_volume(spark: SparkSession) -> DataFrame:
    return volume(spark, "grid", GRID_SHAPE)


def vec_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return volume(spark, "vec", (int(n) // 20 + 1, *VEC_SIDES))
