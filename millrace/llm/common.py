"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session may make its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, values: tuple[int, ...], tag: str) -> list[DataFrame]:
    """As :func:`stored`, one table for each value of the last column, an int."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(key).parquet(path)
    fields = df.drop(key).schema
    out = []
    for v in values:
        at = f"{path}/{key}={v}"
        target = spark._jvm.org.apache.hadoop.fs.Path(at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)  # for values without rows
        out.append(spark.read.schema(fields).parquet(at))
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
