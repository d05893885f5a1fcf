"""Nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.rank import top

BLOCK = 2048


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` largest scores of each row, ties to the smaller id; only rows' best are sorted."""
    m = scores.shape[1]
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(len(scores), -np.inf)
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[row, column], -scores[row, column], row))
    row, column = row[order], column[order]
    at = np.searchsorted(row, np.arange(len(scores)))[:, None] + np.arange(min(k, m))
    return ids[row[at], column[at]], scores[row[at], column[at]]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): for each of ``queries`` the ``k`` of ``vectors(vec_id, embedding)`` with the largest
    dot product in double, ties to the smaller id.

    Queries go in blocks of bounded size, one broadcast a block; a task keeps k vectors a query, so no
    pairs but those are written.
    """
    spark = vectors.sparkSession
    out, held = None, []

    def one(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            held_ids, held = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column("embedding")
                v = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                ids_now = np.concatenate([held_ids, np.broadcast_to(b.column("vec_id").to_numpy(), (len(qid), b.num_rows))], axis=1)
                # What is no number is as far as can be.
                now = np.nan_to_num(np.concatenate([held, q @ v.T], axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                held_ids, held = best(ids_now, now, k)
            yield pa.record_batch([pa.array(np.repeat(qid, held.shape[1])), pa.array(held_ids.ravel()), pa.array(held.ravel())], names=["query_id", "vec_id", "score"])

        return vectors.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(run, "query_id long, vec_id long, score double")

    for row in queries.select("vec_id", "embedding").filter("embedding is not null").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = one(held) if out is None else out.unionByName(one(held)), []
    if held or out is None:
        last = one(held) if held else vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
        out = last if out is None else out.unionByName(last)
    return top(out, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
