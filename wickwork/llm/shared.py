"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside these: space and the five ASCII controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder in the one that all executors share. Only a local master may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what :func:`cut` has written in this session; results that read it must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It ends the lineage, so a lost executor costs a file read and not a recomputation, and later joins see
    true sizes: adaptive execution can broadcast, or split a skewed side, from what is measured.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: str):
    """A 64-bit key of a row's content; rows with equal content share it and get equal results."""
    return F.xxhash64(*columns)


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


#: Positions of the bitmap that :func:`likely` sends to every task: 8 MB, whatever the number of keys.
BITMAP = 1 << 26
_GROUP = 1 << 15


def likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_likely``: true for every row whose ``key`` (a hash) is among ``keys`` (one column), and for few others.

    It is read off a bitmap of hashed keys that has a fixed size, so it can be broadcast beside any number of rows. It
    keeps rows that a join cannot match out of that join's shuffle; a false alarm only costs the row's shuffle.
    """
    at = F.pmod(F.col(keys.columns[0]), F.lit(BITMAP))
    bits = keys.groupBy((at / _GROUP).cast("int").alias("_group")).agg(
        F.bitmap_construct_agg(F.pmod(at, F.lit(_GROUP))).alias("_bits"))
    bits = cut(bits)
    rows = rows.withColumn("_at", F.pmod(F.col(key), F.lit(BITMAP))).withColumn("_group", (F.col("_at") / _GROUP).cast("int"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int((_at % {_GROUP}) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.getbit(byte.cast("long"), F.expr("int(_at % 8)")) == 1
    return rows.join(F.broadcast(bits), "_group", "left").withColumn("_likely", F.coalesce(hit, F.lit(False))).drop("_group", "_at", "_bits")


#: A key with more than this share of the rows is heavy; so there are fewer heavy keys than this number.
SHARE = 10_000


def split_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once and in ``count`` about how many rows hold it.

    The heavy keys of the table, fewer than ``SHARE`` by their definition, are broadcast, so no task gets all rows of one;
    the others are joined by a shuffle. ``rows`` is read twice and should be a written table.
    """
    least = (table.agg(F.sum(count)).first()[0] or 0) / SHARE
    heavy = F.broadcast(table.filter(F.col(count) > least))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.filter(F.col(count) <= least), key)
    return rows.join(heavy, key).unionByName(light)


#: Bytes of one block of a side that is sent to every task.
BLOCK_BYTES = 16 << 20


def blocks(rows: DataFrame, weight, *key: str, most: int = BLOCK_BYTES):
    """``rows`` in parts of about ``most`` bytes each, by a hash of ``key``; ``weight`` is a column with the bytes of a row.

    Each part can be sent to every task, whatever the size of the whole: the caller passes over its other side once a part.
    """
    rows = cut(rows)
    n = -(-int(rows.agg(F.sum(weight)).first()[0] or 0) // most)
    for i in range(max(n, 1)):
        yield rows if n <= 1 else rows.filter(F.pmod(F.xxhash64(*key), F.lit(n)) == i)
