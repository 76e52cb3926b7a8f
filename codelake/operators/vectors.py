"""Exact nearest neighbours by cosine for a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4_000  # query vectors that a task holds at a time


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """(vec_id, other, cosine): the k nearest other vectors of each query, ties by id; zero and null vectors have none.

    The queries go to the tasks in blocks of ``BLOCK`` rows; each task keeps
    the k best of its own vectors for each query, and the best of these are
    picked by a window, so no pair beyond k for each task is ever written.
    """
    sc = vectors.sparkSession.sparkContext
    q = queries.filter("embedding is not null").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    n = q.count()
    out = None
    for b in range(max(1, -(-n // BLOCK))):
        part = q if n <= BLOCK else q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // BLOCK))) == b)
        held = sc.broadcast(part.toPandas())
        got = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(_best(held, k, digits), "vec_id long, other long, cosine double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    return out.dropDuplicates(["vec_id", "other"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _best(held, k: int, digits: int):
    def run(batches):
        qs = held.value
        if not len(qs):
            return
        ids = qs["vec_id"].to_numpy()
        a = np.array(qs["embedding"].tolist(), np.float64)
        na = np.linalg.norm(a, axis=1)
        for g in batches:
            if not len(g):
                continue
            v = np.array(g["embedding"].tolist(), np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.round(a @ v.T / (na[:, None] * np.linalg.norm(v, axis=1)[None, :]), digits)
            other = g["vec_id"].to_numpy()
            s[~np.isfinite(s)] = -9.0
            s[ids[:, None] == other[None, :]] = -9.0
            order = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :k]
            score = np.take_along_axis(s, order, 1)
            keep = score > -9.0
            yield pd.DataFrame({"vec_id": np.repeat(ids, order.shape[1])[keep.ravel()], "other": other[order].ravel()[keep.ravel()], "cosine": score.ravel()[keep.ravel()]})
    return run
