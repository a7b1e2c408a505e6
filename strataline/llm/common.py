"""Pieces that several operators of this subpackage share.

Every operator follows the same rules: a null text counts as the empty text, internal columns begin
with ``__`` and two letters of the operator, and columns of the input whose names clash with a result
column are replaced by the result.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Side tables up to this many bytes are broadcast after their size was measured; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: The most keys of a table that count as hot: those with this share of its rows.
HOT_KEYS = 1000
#: Rows in one Arrow batch handed to Python; bounds a worker's memory when texts are long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on: bounded Arrow batches and a checkpoint folder.

    The checkpoint folder is the one in spark.checkpoint.dir; only where that is unset and everything runs in
    one process (tests) a temporary folder is taken. The batch size holds for the session from then on, as
    results are computed later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataline-checkpoint-"))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    What was shuffled for it is removed when it is written, not when the driver happens to collect garbage.
    """
    path, conf = shared_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_columns(df: DataFrame, replaced: set[str]) -> list[str]:
    """Columns of df that a result with the columns ``replaced`` keeps."""
    low = {x.lower() for x in replaced}
    return [c for c in df.columns if c.lower() not in low]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_enough(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its measured size allows; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(rows, row_bytes) else df


def hot_share(rows: int) -> int:
    """A key is hot from so many of ``rows`` rows on: at most HOT_KEYS keys are, whatever the data."""
    return max(1, -(-rows // HOT_KEYS))


def looked_up(rows: DataFrame, known: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """``rows`` left-joined with ``known``, which has one row a key.

    A known table of a measured small size is broadcast. Beyond it both sides are shuffled, but for the
    rows of hot keys, whose at most HOT_KEYS known rows are broadcast, and those without a key.
    """
    if small_enough(known.count(), row_bytes):
        return rows.join(F.broadcast(known), key, "left")
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= hot_share(rows.count())).select(key)
    hot = written(hot.withColumn("__hot", F.lit(True)), "hot-keys")
    marked = rows.join(F.broadcast(hot), key, "left")
    parts = (marked.where("__hot"), F.broadcast(known.join(F.broadcast(hot.select(key)), key, "left_semi"))), (marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()), known), (marked.where(F.col(key).isNull()), F.broadcast(known.limit(0)))
    out = [part.join(table, key, "left").drop("__hot") for part, table in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (nulls as empty) and the n + 1 offsets of its rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(batches, size: int):
    """Arrow batches put together until their texts (column 'text') have ``size`` bytes: for work that is cheaper in bulk."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces_of(batch, size: int):
    """Slices of an Arrow batch of about ``size`` text bytes each (its column 'text'), one row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def _with_value(rows: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) joined with ``values`` (a, m, n), where n is the number of rows of a.

    A key with a large share of the rows is never gathered in one task: the values of the hot ones, at
    most 2 * HOT_KEYS by their counts, are broadcast.
    """
    bar = hot_share(total)
    hot, cold = values.where(F.col("n") >= bar).select("a", "m"), values.where(F.col("n") < bar).select("a", "m")
    # rows of hot keys leave before the shuffle; the others meet their values there
    near = rows.join(F.broadcast(hot.withColumnRenamed("m", "hot_m")), "a", "left")
    done = near.where("hot_m IS NOT NULL").select("a", "b", F.col("hot_m").alias("m"))
    return done.unionByName(near.where("hot_m IS NULL").select("a", "b").join(cold, "a"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the smallest node reachable.

    Alternates large-star and small-star contraction: each round is two aggregations and two equi-joins,
    nothing but three numbers reaches the driver, and each round's edges are checkpointed to the shared
    folder. The hub of a star, as all members of a component end up in one, is summed before it is shuffled
    and joined by broadcast. Null ends and self-loops are ignored; repeated edges count once; no edges give
    no rows.
    """
    prepare(edges.sparkSession)
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    seen, total = None, e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _with_value(both, least, total).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        e = (
            _with_value(large, low, total)
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
            .checkpoint()
        )
        total, *now = e.agg(F.count("*"), F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
