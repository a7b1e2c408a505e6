"""Vector search: filtered top-k by cosine, one row per commit, lateral top-k per hit."""

from __future__ import annotations

import functools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import columns as C


def scored(rows: DataFrame, query: list[float] | Column, vector_col: str = "vector") -> DataFrame:
    """rows with score = cosine to the query, without the vector; rows of zero vectors have none and are left out."""
    if isinstance(query, Column):
        q, norm = query, None
    else:  # one constant, whose length is not computed again for every row
        q = F.split(F.lit(",".join(repr(float(x)) for x in query)), ",").cast("array<double>")
        norm = F.lit(math.sqrt(functools.reduce(lambda s, x: s + float(x) * float(x), query, 0.0)))
    return rows.withColumn("score", C.cosine(F.col(vector_col), q, norm)).where("score IS NOT NULL").drop(vector_col)


def top_k(rows: DataFrame, query, k: int, vector_col: str = "vector", tie: str = "id") -> DataFrame:
    """The k best rows; a bounded top-k per task, then of those: no full sort."""
    return scored(rows, query, vector_col).orderBy(F.desc("score"), tie).limit(k)


def history_filter(after=None, before=None, author=None, file=None, commit_type=None, decision_class=None) -> Column:
    """The conjunction of the given conditions on history rows, as typed columns."""
    when = lambda x: F.try_to_timestamp(F.lit(x))
    parts = [F.col("ts") > when(after)] if after else []
    parts += [F.col("ts") < when(before)] if before else []
    parts += [F.col(c) == F.lit(v) for c, v in (("author", author), ("file_path", file), ("commit_type", commit_type), ("decision_class", decision_class)) if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def best_per_commit(hits: DataFrame, key: str = "sha", tie: str = "id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return hits.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def search_history(history: DataFrame, query, limit: int = 5, condition: Column | None = None, unique_commits: bool = False, sort: str = "relevance", dedup_after_limit: bool = False) -> DataFrame:
    """Hits with score and retrieval_method. One row per commit is chosen before the limit, unless told otherwise."""
    rows = scored(history if condition is None else history.where(condition), query)
    best = lambda df: df.orderBy(F.desc("score"), "id").limit(limit)
    hits = best_per_commit(best(rows)) if unique_commits and dedup_after_limit else best(best_per_commit(rows)) if unique_commits else best(rows)
    hits = hits.withColumn("retrieval_method", F.lit("vector"))
    return hits.orderBy(F.desc("ts"), "id") if sort == "date" else hits.orderBy(F.desc("score"), "id")


def search_code(chunks: DataFrame, query, limit: int = 5, prefix: str | None = None) -> DataFrame:
    rows = chunks if not prefix else chunks.where(F.col("file_path").startswith(prefix))
    return top_k(rows, query, limit)


def lateral_top_k(hits: DataFrame, history: DataFrame, query, k: int = 3) -> DataFrame:
    """For every hit the k best history rows of its file: (hit_id, rank, score, ...).

    Hits are few; the join is by file, and the row_number filter keeps k rows per hit before the shuffle.
    """
    side = hits.select(F.col("id").alias("hit_id"), "file_path")
    rows = scored(history, query).join(F.broadcast(side), "file_path")
    order = Window.partitionBy("hit_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Queries that are compared with all rows at once; their vectors are broadcast.
QUERY_BLOCK = 4096


def top_k_many(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, rank, id, score): the k best of ``rows`` by cosine for every one of ``queries`` (id and vector each).

    Queries go in blocks of about QUERY_BLOCK, dealt by a hash; a block's vectors are broadcast, and every batch of
    rows is compared with them by one matrix product that keeps k rows a query. So a block costs one scan of
    the vectors and a shuffle of k rows a task and query; nothing else grows with the product of both sides. Of
    equal scores the smaller id wins. Rows and queries of zero or null vectors have no score.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where("vector IS NOT NULL")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    side = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    found = [_best_of_block(side, parts.where(F.col("part") == b), k) for b in range(blocks)]
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_block(rows: DataFrame, block: DataFrame, k: int) -> DataFrame:
    got = block.select("id", "vector").toPandas()  # at most about QUERY_BLOCK rows
    names = got["id"].to_numpy()
    matrix = np.stack([np.asarray(v, float) for v in got["vector"]]) if len(got) else np.zeros((0, 1))
    size = np.linalg.norm(matrix, axis=1)
    shared = rows.sparkSession.sparkContext.broadcast((names[size > 0], matrix[size > 0] / size[size > 0, None]))

    def run(batches):
        import pyarrow as pa

        ids, unit = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            column = batch.column("vector")
            given = np.asarray(column.flatten(), float).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(given, axis=1)
            mine = batch.column("id").to_numpy()[norm > 0]
            order = np.argsort(mine, kind="stable")
            score = unit @ (given[norm > 0][order] / norm[norm > 0][order, None]).T
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(mine[order][best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query", "id", "score"])

    return rows.mapInArrow(run, "query long, id long, score double")
