"""What the operators of this folder share: reading tables, the shared scratch folder, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_folder, small_batches

#: White space as Unicode has it. No pre-token of a byte-level tokenizer goes on from another character to white space, so
#: texts fall apart into chunks of blanks and what follows them, and a chunk's tokens depend on nothing else.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_HELD: dict[str, object] = {}


def held(owner: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker under ``owner`` between tasks.

    Spark's workers live on from stage to stage, so a worker holds one owner's tables at a time: asking for another's
    frees what was there. Each owner bounds its own.
    """
    if owner not in _HELD:
        release()
        _HELD[owner] = make()
    return _HELD[owner]


def release() -> None:
    """Free what an earlier stage left in this Python worker, and give the memory back to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def no_collector():
    """Without the collector of cycles: where none arise, it walks large tables again and again for nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than the stage at hand."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table that is read again; its lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is linked with) of every node in ``edges`` (a, b).

    Alternating large and small stars: each round is a few grouped minima and equi-joins, so a node with very many
    links is split like any skewed key. Each round is written and the one before it deleted.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(pairs)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(most_rounds):
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = scratch.keep(small.unionAll(least.select("u", F.col("low").alias("v"))).distinct())
        scratch.drop(now)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
