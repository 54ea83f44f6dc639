"""What the operators of this subpackage share: written intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one row in so many; there are fewer such keys than this.
HOT_SHARE = 1024
#: Rows of a key that any task can take.
LEAST_HOT = 1 << 14


#: The temporary folder of each application whose session names none.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where it is unset, as in tests on one machine, a temporary folder is made, one for each application.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _TEMPORARY:
        _TEMPORARY[own] = tempfile.mkdtemp(prefix="wordloom-")
        atexit.register(shutil.rmtree, _TEMPORARY[own], ignore_errors=True)
    return _TEMPORARY[own]


#: What undoes the tables of each open scope, innermost last.
_SCOPES: list[list[Callable[[], None]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables that operators write within are deleted at its end: what a result is still computed from must
    have been written or consumed by then. Without a scope they stay in the shared folder."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for undo in reversed(_SCOPES.pop()):
            undo()


def undone_by(undo: Callable[[], None]) -> None:
    if _SCOPES:
        _SCOPES[-1].append(undo)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; does nothing where there is no JVM at hand (Spark Connect)."""
    if jvm := getattr(spark, "_jvm", None):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """`df`, computed once and read back from a table in the shared folder: its lineage ends there. A lasting table
    outlives the scope it is written in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not lasting:
        undone_by(lambda: delete_path(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of shuffle files that only older steps needed, now and not when the driver happens to collect its garbage."""
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def release_memory() -> None:
    """Gives back what a Python worker has freed: workers are used again for other tasks, and Arrow and the C library keep
    freed memory, which an executor's workers then hold beside its heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not on glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task over batches that gives back what it freed at its end, when its last batches and arrays are let go."""

    @wraps(task)
    def run(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            release_memory()

    return run


def tidy(df: DataFrame) -> DataFrame:
    """`df` written, and what only older steps needed let go."""
    out = written(df)
    collect_garbage(df.sparkSession)
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; `lower` alone would also change other letters."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, hottest: int | None = None) -> DataFrame:
    """Inner join of `left` with `right`, which has each key once and in `count` the rows `left` has for it.

    Keys with more than 1/HOT_SHARE of all rows, and more than LEAST_HOT, are joined by broadcast: there can only be
    HOT_SHARE of them, however large the tables are. All others are small enough to shuffle. Without a hot key nothing
    goes through the driver: the join is a sorted one, whatever the sizes. hottest: the largest count, if it is known;
    else `right` is written first.
    """
    if hottest is None:
        right = written(right)
        hottest = right.agg(F.max(count)).first()[0] or 0
    if hottest <= LEAST_HOT or hottest * HOT_SHARE <= total:
        return left.join(right.hint("merge"), key)
    hot = (F.col(count) * HOT_SHARE > F.lit(total)) & (F.col(count) > LEAST_HOT)
    few = F.broadcast(right.filter(hot))
    rest = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(right.filter(~hot).hint("merge"), key))


def hashed_sample(df: DataFrame, column: str, rows: int, most: int) -> DataFrame:
    """About `most` of `df`'s `rows` rows, never more, all if there are no more: those whose `column` hashes low.

    A threshold on the hash leaves each partition with its share; a sort with a limit would send the driver as many
    rows from every partition.
    """
    if rows <= most:
        return df
    share = 0.95 * most / rows
    low = F.lit(int(share * 2.0**64) - 2**63)
    return df.filter(F.xxhash64(F.col(column), F.lit(1)) < low).limit(most)


#: Bits of the filter that tells rows apart which need a closer look: 4 MB, however many ids there are. With very many ids
#: it lets more rows through than need be, up to all.
FILTER_BITS, MAP_BITS = 1 << 25, 1 << 15


def split_by_suspicion(docs: DataFrame, id_col: str, suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` in two parts: rows whose id is surely not among `suspects` (a column `id`), and the rest, among them all of its
    rows. Nothing of `docs` is shuffled: a bitmap of fixed size over the hashed ids is joined by broadcast."""
    bucket, bits = unused(docs, "filter_map"), unused(docs, "filter_bits")

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    bit = F.col("place") % MAP_BITS
    maps = suspects.select(place(F.col("id")).alias("place")).groupBy(F.expr(f"place div {MAP_BITS}").alias(bucket)).agg(F.bitmap_construct_agg(bit).alias(bits))
    marked = docs.withColumn(bucket, F.floor(place(F.col(id_col)) / MAP_BITS).cast("bigint")).join(F.broadcast(written(maps)), bucket, "left")
    at = place(F.col(id_col)) % MAP_BITS
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast(pmod(xxhash64(`{id_col}`), {FILTER_BITS}L) % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)) != 0, F.lit(False))
    return tuple(marked.filter(test).select(*[F.col(f"`{c}`") for c in docs.columns]) for test in (~hit, hit))


def keep_one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """`docs` with one row for each id of `kept` (a column `id` without repeats, null among them if it is to be kept);
    columns as they were, whatever their names. Of rows that repeat an id, the one whose values hash lowest stays.

    Rows whose ids are kept and don't repeat, most of them as a rule, are not moved.
    """
    counts = docs.select(F.col("doc_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(kept.select(F.col("id").alias("kept_id"), F.lit(True).alias("is_kept")), F.col("id").eqNullSafe(F.col("kept_id")), "left")
    suspects = written(both.filter("is_kept is null or n > 1").select("id", "is_kept"))
    sure, unsure = split_by_suspicion(docs, "doc_id", suspects)
    name, nth = unused(docs, "dropped_id"), unused(docs, "kept_nth")
    dropped = suspects.filter("is_kept is null").select(F.col("id").alias(name))
    left = unsure.join(dropped, unsure["doc_id"].eqNullSafe(dropped[name]), "left_anti")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return sure.unionByName(left.withColumn(nth, order).filter(F.col(nth) == 1).drop(nth))
