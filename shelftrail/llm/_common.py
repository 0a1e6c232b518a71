"""What the operators of this package share: table reads, shared storage and text keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inside of a regex class: ASCII white space, as the contracts name it.
ASCII_SPACE = "\\x20\\x09-\\x0D"
#: The same characters, for `btrim`.
SPACE_CHARS = " \t\n\x0b\x0c\r"

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Unset, a local session (as in tests) gets a temporary folder of its own; a cluster gets an error,
    because a machine's own folder would lose intermediate tables with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that only the steps of one operator read; `clear` deletes them once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []


def carried(docs: DataFrame) -> list[Column]:
    """The columns of `docs` as they are, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones for the same table: those whose key has a hash below a bound, which leaves about
    `rows` of them, so that no more than these move, and of them the smallest."""
    n = df.count()
    spread = F.xxhash64(F.lit(1), key)
    if n > rows:
        df = df.where(F.pmod(spread, F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.1 * rows / n)))
    return df.orderBy(spread, key).limit(rows)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_pair(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key. The second starts from another seed; a seed behind the key would only hash the first again."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def ascii_lower_key(text: Column) -> Column:
    """A string that is equal for two texts exactly when they are equal after lower-casing A-Z alone.

    `lower` would fold all of Unicode and `translate` walks code points through a hash map. Reading the UTF-8
    bytes as Latin-1 first leaves `lower` two ranges to change: A-Z, and 0xC0-0xDE, which are only lead bytes.
    The number of continuation bytes after a lead byte still tells the two- from the three- and four-byte leads
    that it may now equal, so no two different texts meet. Use it for hashing and comparing, not for output.
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
