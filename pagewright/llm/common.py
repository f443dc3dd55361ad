"""What the operators of this subpackage share: tables in the shared folder, joins that
survive a hot key, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's address below the folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and all executors run in this process, as in the tests, a
    folder of this machine is set for the rest of the session; on a cluster that is an error."""
    base = spark.conf.get(_OWN, None) or spark.sparkContext.getConf().get(_OWN)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_OWN} must name a folder that all executors share; master is {master}")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set(_OWN, base)
    return f"{base.rstrip('/')}/pagewright-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost
    executor takes nothing with it."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Delete a written table that no later step reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else list({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over, so that a chain of
    jobs holds the disk of one of them at a time. The cleaner works in the background."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, count: str, parts: int = 256) -> DataFrame:
    """left join of `right`, which has one row a key and in `count` the rows that `left` has of it.

    Keys with at least 1/parts of all rows, of which there are at most `parts`, are broadcast;
    the rest is joined by a shuffle in which no key is hot."""
    total = right.agg(F.coalesce(F.sum(count), F.lit(0)).alias("s")).first()["s"]
    hot = right.where(F.col(count) * parts >= F.lit(total)).limit(parts)
    cold = right.where(F.col(count) * parts < F.lit(total))
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = [c for c in right.columns if c != key]
    a = marked.where(F.col("_hot").isNotNull()).drop("_hot")
    b = marked.where(F.col("_hot").isNull()).drop("_hot", *rest).join(cold, key, "left")
    return a.unionByName(b.select(*a.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): connected components of undirected edges by distributed union-find.

    Large-star and small-star steps alternate on tables of edges until they are stars: each step
    is two shuffles of two numbers an edge, so no component is held by one task. root is the
    least node of the component. Self-loops and repeated edges are allowed. Nodes must not be
    null. The result is a written table."""
    spark = edges.sparkSession
    cur = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    for _ in range(rounds):
        # stars: nobody has two edges down, nor one down and one up
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.unionAll(cur.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if ends.where("down > 1 or (down = 1 and up = 1)").isEmpty():
            break
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small)
        delete(cur, spark)
        cur = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out = materialise(out)
    delete(cur, spark)
    return out


def nested(docs: DataFrame, name: str = "d") -> Column:
    """A row of `docs` as one struct column, so that its columns' names can't clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unnested(df: DataFrame, docs: DataFrame, new: dict[str | None, Column], name: str = "d") -> DataFrame:
    """The columns of `docs` out of the struct that `nested` made, those in `new` replaced (cast to
    the old type); names in `new` that `docs` hasn't are passed over."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return df.select(*[(new[c].cast(kinds[c]) if c in new else F.col(name).getField(c)).alias(c) for c in docs.columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once a row even where `use` has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bucket_count(rows: int, per: int) -> int:
    """How many hash buckets give about `per` rows each."""
    return max(1, -(-rows // per))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str, name: str, per: int = 50_000, spread: str = "_spread") -> DataFrame:
    """Adds `name`, the sum of `value` over the rows before this one of the same group, in an
    order fixed by hash buckets of `spread` and by `order` within them; and `_at`, the row's
    number in its bucket.

    Two levels: sums within (group, bucket), which spread a hot group over many tasks, then
    over the buckets of a group. `df` should be a written table: it is read three times."""
    n = bucket_count(df.count(), per)
    df = df.withColumn("_bucket", F.pmod(F.col(spread), F.lit(n)).cast("int"))
    w = Window.partitionBy(*group, "_bucket").orderBy(*order)
    inner = df.withColumns(
        {
            "_at": F.row_number().over(w),
            "_before": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    return inner.join(sums, [*group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_offset")).drop("_before", "_offset")
