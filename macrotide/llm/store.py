"""Tables written to the shared folder, so that a lost executor never costs a recomputation from the start."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.functions.shipping import ship


#: Tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-macrotide-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for stored in tables:
        jvm = stored.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(stored.stored_at)
        path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each of some keys, which may be few (a key of ``rows`` may then hold most rows) or many."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema if f.dataType.simpleString() == "string"]
    (held,) = small.agg(F.sum(sum(strings, F.lit(16 * len(small.columns))))).first()
    return rows.join(F.broadcast(small) if (held or 0) <= BROADCAST_BYTES else small, keys, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
