"""Helpers of this subpackage: shared work folder, written intermediate tables, self-contained task code."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a
    cluster is refused, since its machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fleetsense-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """name, made longer until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def distinct_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), row, copies: each (doc_id, text) once, with the number of equal rows.

    row is a hash of both. Texts are shuffled only where equal rows exist, and only those."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text"))
    twins = saved(rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twins")
    if twins.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    once = rows.join(twins, "row", "left_anti").select("doc_id", "text", "row", F.lit(1).cast("long").alias("copies"))
    more = rows.join(twins.select("row"), "row", "left_semi").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return once.unionByName(saved(more, "merged-twins"))


def sent(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size together with its classes; pickle.loads(x.value) in a task gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def ship(name: str) -> None:
    """Send the functions of a module to the workers by value, so that workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
