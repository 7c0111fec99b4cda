"""What several operators share: words of a text and tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A-Z become a-z; digits, a-z and all bytes from 0x80 stay; any other byte separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_OWN: dict[str, str] = {}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (runs of digits, a-z and non-ASCII characters) of a whole text; none for null."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        own = tempfile.TemporaryDirectory(prefix="inkfold-")
        atexit.register(own.cleanup)
        _OWN["dir"] = f"file://{own.name}"
    return _OWN["dir"]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and a lost executor costs no rework."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of stored() that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """stored() for tables that are not needed beyond the block."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        made.append(stored(df, name, *partition_by))
        return made[-1]

    yield keep
    for df in made:
        dropped(df)


#: A key with more than one in this many rows of a join's side is hot, so at most so many keys are.
HOT_SHARE = 2000


def spread_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """big.join(small, key, how) with how inner or left, where a key may hold a large share of big's rows and small has one row for each key.

    The rows of a hot key are dealt by spread_by over several tasks, to each of which the key's row of small is copied: a
    task gets few more rows of one key than one in HOT_SHARE of all. What is broadcast are hot keys and their numbers of
    tasks, at most HOT_SHARE rows; the copies are at most twice as many. big is read twice, so it should be a stored table.
    """
    counts = big.groupBy(key).agg(F.count("*").alias("rows"))
    most = big.agg((F.count("*") / HOT_SHARE).alias("most"))
    tasks, task = fresh_name(big, "tasks"), fresh_name(big, "task")
    hot = F.broadcast(counts.join(F.broadcast(most), F.col("rows") > F.col("most")).select(key, F.ceil(F.col("rows") / F.col("most")).cast("int").alias(tasks)))
    number = F.coalesce(F.col(tasks), F.lit(1))
    dealt = big.join(hot, key, "left").withColumn(task, F.pmod(F.xxhash64(spread_by), number).cast("int")).drop(tasks)
    copied = small.join(hot, key, "left").withColumn(task, F.explode(F.sequence(F.lit(0), number - 1))).drop(tasks)
    return dealt.join(copied, [key, task], how).drop(task)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or name with marks before it if df has such a column already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def released() -> None:
    """Give memory that a worker no longer uses back to the system, as it stays for later tasks of other operators."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
