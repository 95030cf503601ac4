"""A store of runs: one folder a run, documents as lines of JSON, tolerant of what older programs and accidents left there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The documents of this version. Older ones call a symbol ``ticker``, have no ``meta.profile`` and no lists of closed rows.
SIGNAL = "pattern: string, status: string, entry: double, stop: double, target: double, score: int, last_date: date"
DOCUMENT = (f"version int, symbol string, ticker string, meta struct<run_date: date, profile: string>, signals array<struct<{SIGNAL}>>, "
            "closed array<struct<pattern: string, stop: double, outcome: string>>, _corrupt_record string")


def documents(signals: DataFrame, profile: str) -> DataFrame:
    """One document for each run and symbol of a signal log: run, version, symbol, meta, signals."""
    one = F.struct("pattern", "status", "entry", "stop", "target", "score", F.col("day").alias("last_date"))
    d = signals.groupBy("run", F.col("symbol").cast("string").alias("symbol")).agg(F.max("day").alias("_day"), F.sort_array(F.collect_list(one)).alias("signals"))
    return d.select("run", F.lit(2).alias("version"), "symbol", F.struct(F.col("_day").alias("run_date"), F.lit(profile).alias("profile")).alias("meta"), "signals")


def write(docs: DataFrame, path: str) -> None:
    """Write the runs that ``docs`` has; other runs in the store stay, and a run written again replaces itself."""
    # Documents of a run lie together, so a run is few files.
    docs.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All readable documents: run, symbol, profile, run_date, signals, closed. ``run`` is the folder, so a filter on it reads
    those folders only.

    A line that is no document is passed over, whatever else its file holds; see :func:`unreadable`. What an older version
    lacks is null, or empty where it is a list.
    """
    d = _lines(spark, path).filter("_corrupt_record is null and coalesce(symbol, ticker) is not null")
    empty = lambda c: F.coalesce(c, F.array().cast(d.schema[c].dataType)).alias(c)
    return d.select("run", F.coalesce("symbol", "ticker").alias("symbol"), F.col("meta.profile").alias("profile"), F.col("meta.run_date").alias("run_date"), empty("signals"), empty("closed"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(run, line): what :func:`read` passed over."""
    d = _lines(spark, path).filter("_corrupt_record is not null or coalesce(symbol, ticker) is null")
    return d.select("run", F.coalesce("_corrupt_record", F.lit("no symbol")).alias("line"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromDDL(DOCUMENT).add("run", "long")
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The documents of the newest run (before run ``before``, if given): the folders tell which it is, and only it is read."""
    d = read(spark, path)
    d = d if before is None else d.filter(F.col("run") < before)
    newest = _lines(spark, path).select("run").filter(F.lit(True) if before is None else F.col("run") < before).agg(F.max("run")).first()[0]
    return d.filter(F.col("run") == newest)


def signals(docs: DataFrame) -> DataFrame:
    """The signals of documents, a row each."""
    return docs.select("run", "symbol", "profile", F.explode("signals").alias("s")).select("run", "symbol", "profile", "s.*")
