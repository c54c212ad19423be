"""Helpers that the training-data operators share: tables, staged intermediates, words."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space. Bytes of
# 0x80 and above stay, so what is left between spaces are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes; null and empty texts have none."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on one machine, as in tests, may it be unset: a temporary folder is then made. A cluster
    without the setting is an error, as its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = _local.get(spark.sparkContext.applicationId)
        if not found:
            found = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="swarmlake-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


_local: dict[str, str] = {}
_roots: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediates of all operators called so far; their results must have been used or written."""
    while _roots:
        _delete(spark, _roots.pop())


class Scratch:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    A staged table cuts lineage like a checkpoint, and a lost executor costs only a re-read. What the
    operator's result no longer reads is dropped at once, the rest by `clear_scratch`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/swarmlake-{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, most: int = 50_000) -> DataFrame:
    """Inner join of rows to one row per key, without a hot key.

    `size` of a group counts its rows and `total` bounds the sum of all sizes. Groups of at least
    total / `most` rows are at most `most` by count and are broadcast; in the shuffled join of the
    others no key has more rows than that.
    """
    large = F.col(size) >= max(1000, -(-total // most))
    hot = F.broadcast(groups.filter(large))
    rest = rows.join(F.broadcast(groups.filter(large).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.filter(~large), keys))
