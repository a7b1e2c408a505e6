"""Exact de-duplication with counting quotient filters.

1. Every partition puts the 64-bit fingerprints of its texts into a counting quotient filter: the high
   bits (quotient) address a slot, the remaining bits (remainder) are kept sorted within the slot's run,
   and each remainder has a count. Nothing is rounded away, so the filter is lossless.
2. The filters are cut into blocks of adjoining quotients; a block's pieces from all partitions merge by
   their sorted remainders and add their counts. A fingerprint enters a block once per partition, however
   many copies there are, so a block holds a bounded number of entries.
3. Fingerprints with a merged count above one route their rows to byte verification: rows are grouped by
   fingerprint *and* whole text, so that equality is Spark's comparison of the bytes. All other rows are
   unique without further work and are never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import kept_columns, maybe_broadcast, prepare, quoted, text_of, written

#: Fingerprints that one block of the merged filter holds, about.
BLOCK_ENTRIES = 100_000
#: A fingerprint is hot when it has this share of the rows and HOT_ROWS of them; at most HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1000, 1000

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


class CountingQuotientFilter:
    """Sorted remainders with counts, by quotient. ``starts[q]:starts[q + 1]`` is the run of quotient q."""

    def __init__(self, qbits: int, starts: np.ndarray, remainders: np.ndarray, counts: np.ndarray, first: int = 0):
        self.qbits, self.starts, self.remainders, self.counts, self.first = qbits, starts, remainders, counts, first

    @classmethod
    def build(cls, fingerprints: np.ndarray, qbits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls._of(values, counts.astype(np.int64), qbits, 0, 1 << qbits)

    @classmethod
    def _of(cls, values: np.ndarray, counts: np.ndarray, qbits: int, first: int, slots: int) -> CountingQuotientFilter:
        shift = np.uint64(64 - qbits)
        quotient = (values >> shift).astype(np.int64) - first
        starts = np.searchsorted(quotient, np.arange(slots + 1))
        return cls(qbits, starts, values & np.uint64((1 << (64 - qbits)) - 1), counts, first)

    def values(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) + self.first
        return (quotient.astype(np.uint64) << np.uint64(64 - self.qbits)) | self.remainders

    def blocks(self, bits: int):
        """(number, piece) of the 2**bits pieces of adjoining quotients that hold something."""
        slots = 1 << (self.qbits - bits)
        for k in range(1 << bits):
            lo, hi = self.starts[k * slots], self.starts[(k + 1) * slots]
            if hi > lo:
                yield k, CountingQuotientFilter(self.qbits, self.starts[k * slots : (k + 1) * slots + 1] - lo, self.remainders[lo:hi], self.counts[lo:hi], k * slots)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs' rows: runs are merged in order of their remainders, counts add up."""
        a, b = self.values(), other.values()
        values = np.concatenate([a, b])
        order = np.argsort(values, kind="stable")  # two sorted halves: a timsort run merge
        values, counts = values[order], np.concatenate([self.counts, other.counts])[order]
        new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return self._of(values[new], np.add.reduceat(counts, new) if len(new) else counts, self.qbits, self.first, len(self.starts) - 1)

    def count(self, fingerprint: int) -> int:
        q = (fingerprint >> (64 - self.qbits)) - self.first
        lo, hi = self.starts[q], self.starts[q + 1]
        r = np.uint64(fingerprint & ((1 << (64 - self.qbits)) - 1))
        at = lo + np.searchsorted(self.remainders[lo:hi], r)
        return int(self.counts[at]) if at < hi and self.remainders[at] == r else 0

    def dump(self) -> bytes:
        head = np.array([self.qbits, self.first, len(self.starts), len(self.remainders)], np.int64)
        width = np.uint32 if len(self.counts) == 0 or self.counts.max() < 1 << 32 else np.int64
        return b"".join([head.tobytes(), np.array([width == np.uint32], np.int64).tobytes(), np.diff(self.starts).astype(np.uint32).tobytes(), self.remainders.tobytes(), self.counts.astype(width).tobytes()])

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        qbits, first, n, k, narrow = (int(x) for x in np.frombuffer(data, np.int64, 5))
        at = 40
        starts = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n - 1, at), dtype=np.int64)])
        at += 4 * (n - 1)
        remainders = np.frombuffer(data, np.uint64, k, at)
        counts = np.frombuffer(data, np.uint32 if narrow else np.int64, k, at + 8 * k).astype(np.int64)
        return cls(qbits, starts, remainders, counts, first)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of the column fp (long) that occur more than once, by merged quotient filters."""
    bits = max(0, int(np.ceil(np.log2(max(1, rows) / BLOCK_ENTRIES))))
    qbits = bits + 10

    def build(batches):
        import pyarrow as pa

        got = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
        if not got:
            return
        whole = CountingQuotientFilter.build(np.concatenate(got).view(np.uint64), qbits)
        for k, piece in whole.blocks(bits):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([piece.dump()], pa.binary())], ["block", "piece"])

    def merge(part):
        import pyarrow as pa

        level = [CountingQuotientFilter.load(x.as_py()) for x in part.column("piece")]
        while len(level) > 1:  # pairwise, so each entry moves a logarithmic number of times
            level = [level[i].merge(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        more = level[0].counts > 1
        return pa.table({"fp": pa.array(level[0].values()[more].view(np.int64)), "n": pa.array(level[0].counts[more], pa.int64())})

    pieces = fingerprints.select("fp").mapInArrow(build, "block long, piece binary")
    return pieces.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are. Of equal texts the row with the largest id stays (a null id is
    smaller than all others); rows repeated with one id and text count in group_size, and one of them is
    kept. A null text counts as empty. Input columns named like the four results are replaced by them;
    with carry=False only the id column is kept beside them. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    names = [c for c in kept_columns(docs, set(RESULT)) if carry or c == id_col]
    # one struct holds the input row, so no name of the input can clash with ours
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in names]).alias("__xd_row")
    base = docs.select(row, F.col(quoted(id_col)).cast("long").alias("__xd_id"), text_of(quoted(text_col)).alias("__xd_text")).withColumn("__xd_fp", F.xxhash64("__xd_text"))
    rows = docs.count()
    repeated = written(repeated_fingerprints(base.select(F.col("__xd_fp").alias("fp")), rows), "dedup-fingerprints")
    repeated = repeated.select(F.col("fp").alias("__xd_fp"), F.col("n").alias("__xd_n"))
    known = maybe_broadcast(repeated, repeated.count(), 16)

    routed = base.join(known, "__xd_fp", "left")
    alone = routed.where("__xd_n IS NULL").select("__xd_row.*", F.col("__xd_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("__xd_text", 256).alias("text_sha256"))

    # byte verification: the grouping key holds the whole text; partial aggregation collapses copies before the shuffle
    routed = routed.where("__xd_n IS NOT NULL")
    groups = (
        routed.groupBy("__xd_fp", "__xd_text", "__xd_n")
        .agg(F.max("__xd_id").alias("__xd_keep"), F.count("*").alias("__xd_size"))
        .select("__xd_fp", F.sha2("__xd_text", 256).alias("__xd_sha"), "__xd_n", "__xd_keep", "__xd_size")
    )
    groups = written(groups, "dedup-groups")
    member = routed.select("__xd_row", "__xd_id", "__xd_fp", "__xd_n", F.sha2("__xd_text", 256).alias("__xd_sha"))
    # by counting, at most HOT_SHARE fingerprints are hot: their groups are broadcast, the others shuffled
    hot = F.col("__xd_n") >= F.lit(max(HOT_ROWS, rows // HOT_SHARE))
    key = ["__xd_fp", "__xd_sha"]
    few, many = (groups.where(x).drop("__xd_n") for x in (hot, ~hot))
    matched = member.where(hot).join(F.broadcast(few), key).unionByName(member.where(~hot).join(many, key))
    is_keeper = F.col("__xd_id").eqNullSafe(F.col("__xd_keep"))
    cols = ["__xd_row.*", F.col("__xd_keep").alias("keep_id"), F.col("__xd_size").alias("group_size")]
    lost = matched.where(~is_keeper).select(*cols, F.lit(False).alias("kept"), F.col("__xd_sha").alias("text_sha256"))
    return alone.unionByName(lost).unionByName(_one_keeper(matched.where(is_keeper), cols))


def _one_keeper(rows: DataFrame, cols: list) -> DataFrame:
    """Rows that hold their group's largest id; of rows repeated with that id one is kept."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("__xd_fp", "__xd_sha", "__xd_id").orderBy(F.lit(1)))
    return rows.withColumn("__xd_at", order).select(*cols, (F.col("__xd_at") == 1).alias("kept"), F.col("__xd_sha").alias("text_sha256"))
