"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests, a single machine) a temporary folder is taken; on a cluster a missing folder is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rankspark_ckpt_"))


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder; what is written there is deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from there: the result is computed once, has fixed
    partitions, and can be read again after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_none(df: DataFrame, limit: int) -> list | None:
    """The rows of a table meant to be small, or None if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def maybe_broadcast(df: DataFrame, limit: int = 100_000, size: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if the table was measured to hold at most ``limit`` rows and about ``size`` bytes; the join
    works either way. Measuring runs the plan, so give it what is cheap or materialised."""
    row = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(row)).first()
    return F.broadcast(df) if n <= limit and (held or 0) <= size else df


def written(df: DataFrame) -> DataFrame:
    """As materialise(), but as a compressed Parquet table in the checkpoint folder: columns in order of size and
    likeness take far less disk than checkpointed rows. The table is deleted when the application ends."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the keys (a frame of one column): none of those is lost, few
    others stay. The keys become a bitmap of ``bits`` bits (8 MB), whatever their number, which is all that is broadcast:
    its size does not depend on the data. Use it before a join to keep most of a wide table out of the shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # from 1, as the pages count
    key = keys.columns[0]
    at = keys.select(place(F.col(key)).alias("_p")).withColumn("_page", F.bitmap_bucket_number("_p")).repartition("_page")
    pages = at.groupBy("_page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_set"))
    per_page = 8 * 4096
    every = df.sparkSession.range(1, bits // per_page + 1).withColumnRenamed("id", "_page")
    pages = every.join(pages, "_page", "left").select("_page", F.coalesce("_set", F.unhex(F.repeat(F.lit("00"), F.lit(per_page // 8)))).alias("_bits"))
    j = df.withColumn("_p", place(F.col(column))).withColumn("_page", F.bitmap_bucket_number("_p")).join(F.broadcast(pages), "_page")
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return j.where(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number ``name`` from 0 without gaps, contiguous within each partition and in its order: the place
    in the partition plus the sizes of the partitions before it. ``df`` is materialised; what is broadcast is one row per partition."""
    local = materialise(df).withColumn("_m", F.monotonically_increasing_id())
    pid, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return local.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid").select(*df.columns, (at + F.col("_off")).alias(name))
