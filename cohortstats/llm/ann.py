"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector by three rounds of random signs and a fast Hadamard
transform, and takes the nearest signed axis; with several polytopes a table, the nearest axes
of as many rotations are one code. A query probes, in every table, the codes nearest to its own
rotation. Rows of a probed bucket are candidates; only these are measured, exactly. The query
set goes to the executors in blocks of fixed size as tables of probed buckets; rows look
themselves up there and stay where they are, and every task keeps the nearest few of each
query, so nothing of the index is shuffled and a bucket with a third of all rows is spread over
the tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, checkpoint, mapped, table

TABLES, PROBES, NEAREST, SEED = 32, 3, 10, 7
#: Queries sent to the executors at once, and candidates measured at once.
QUERY_BLOCK, PAIRS = 8192, 1 << 15
EVERY = 100


def _signs(tables: int, width: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(np.array([-1.0, 1.0]), (tables, 3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two; keeps lengths."""
    width, h = x.shape[1], 1
    while h < width:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), width)
        h *= 2
    return x / np.sqrt(width)


def rotate(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        unit = _hadamard(unit * s)
    return unit


def _unit(vectors: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    biggest = np.abs(vectors).max(1, initial=0, keepdims=True)
    scaled = vectors / np.where(biggest > 0, biggest, 1)  # squares of very small or large components stay finite
    out[:, : vectors.shape[1]] = scaled / np.maximum(np.sqrt((scaled**2).sum(1, keepdims=True)), 1e-300)
    return out


def buckets(rotated: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis, plus 1 on its positive side."""
    axis = np.argmax(np.abs(rotated), 1)
    return 2 * axis + (rotated[np.arange(len(rotated)), axis] > 0)


def probes(rotated: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of each row, nearest first."""
    both = np.stack((-rotated, rotated), 2).reshape(len(rotated), -1)
    return np.argsort(-both, 1, kind="stable")[:, :n]


def codes(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The bucket of each row in a table: its nearest axes, one a polytope, as digits of one number."""
    out = np.zeros(len(unit), np.int64)
    for s in signs:
        out = out * 2 * unit.shape[1] + buckets(rotate(unit, s))
    return out


def probed(unit: np.ndarray, signs: np.ndarray, n: int) -> np.ndarray:
    """The n buckets of a table whose axes are nearest to each row in sum, nearest first."""
    found, worth = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for s in signs:
        r = rotate(unit, s)
        axes = probes(r, n)
        along = np.take_along_axis(r, axes // 2, 1) * np.where(axes % 2, 1, -1)
        # the n best of a digit more are among the n best so far times the n best axes
        more = (worth[:, :, None] + along[:, None, :]).reshape(len(unit), -1)
        code = (found[:, :, None] * 2 * unit.shape[1] + axes[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(-more, 1, kind="stable")[:, :n]
        found, worth = np.take_along_axis(code, best, 1), np.take_along_axis(more, best, 1)
    return found


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: dim finite components, not all zero, and an id."""
    ids, column = batch.column(0), batch.column(1)
    whole = pa.compute.and_(pa.compute.is_valid(ids), pa.compute.equal(pa.compute.list_value_length(column), dim)).fill_null(False)
    ids, column = ids.filter(whole), column.filter(whole)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null component becomes nan
    good = np.isfinite(flat).all(1) & flat.any(1)
    return ids.to_numpy()[good], flat[good]


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        apart = queries - rows
        out = np.sqrt((apart**2).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out == 0))
        if len(odd):  # squares beyond what a double holds: measured in units of the largest difference
            most = np.abs(apart[odd]).max(1)
            some = np.isfinite(most) & (most > 0)
            out[odd[some]] = np.sqrt(((apart[odd[some]] / most[some, None]) ** 2).sum(1)) * most[some]
    return out


class _Tables:
    """For each table the probed buckets of a block of queries, in order, and who probes them."""

    def __init__(self, queries: np.ndarray, tables: int, polytopes: int, n_probes: int, seed: int):
        self.width = 1 << max(0, queries.shape[1] - 1).bit_length()
        self.signs = _signs(tables * polytopes, self.width, seed).reshape(tables, polytopes, 3, self.width)
        unit = _unit(queries, self.width)
        self.lists = []
        for s in self.signs:
            p = probed(unit, s, n_probes)
            order = np.argsort(p.ravel(), kind="stable")
            found, first = np.unique(p.ravel()[order], return_index=True)
            self.lists.append((found, np.append(first, p.size), order // p.shape[1]))

    def candidates(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one of the n queries and a row that some table has in one bucket, each once."""
        unit, pairs = _unit(rows, self.width), []
        for s, (found, at, of) in zip(self.signs, self.lists, strict=True):
            code = codes(unit, s)
            place = np.minimum(np.searchsorted(found, code), len(found) - 1)
            hit = np.flatnonzero(found[place] == code)
            many = at[place[hit] + 1] - at[place[hit]]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.repeat(hit, many) * n + of[np.repeat(at[place[hit]], many) + inside])
        both = np.unique(np.concatenate(pairs))
        return both % n, both // n


def _search(send, dim: int, tables: int, polytopes: int, n_probes: int, nearest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, qid, queries = send.value
        index = _Tables(queries, tables, polytopes, n_probes, seed) if n_probes else None
        none = np.iinfo(np.int64).max
        best_d, best_id = np.full((len(queries), nearest), np.inf), np.full((len(queries), nearest), none)
        at_once = max(1, PAIRS // 4 // len(queries)) if index is None else max(1, (1 << 20) // len(queries))  # pairs are found for so many rows
        for batch in batches:
            all_ids, all_rows = _matrix(batch, dim)
            for x in range(0, len(all_ids), at_once):
                ids, rows = all_ids[x : x + at_once], all_rows[x : x + at_once]
                if index:
                    q, r = index.candidates(rows, len(queries))
                else:
                    q, r = (k.ravel() for k in np.indices((len(queries), len(ids))))
                other = qid[q] != ids[r]
                q, r = q[other], r[other]
                d = np.concatenate([_distances(queries[q[k : k + PAIRS]], rows[r[k : k + PAIRS]]) for k in range(0, len(q), PAIRS)] or [np.zeros(0)])
                near = d <= best_d[q, -1]
                if near.any():
                    best_d, best_id = _nearest(best_d, best_id, q[near], d[near], ids[r[near]])
        q, k = np.nonzero(best_id != none)
        yield pa.RecordBatch.from_arrays([pa.array(number + q), pa.array(qid[q]), pa.array(best_id[q, k]), pa.array(best_d[q, k])], names=["__q", "query_id", "vec_id", "score"])

    return run


def _nearest(best_d: np.ndarray, best_id: np.ndarray, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each query among those held and the new ones, ties by id."""
    n, nearest = best_d.shape
    d, i, q = np.concatenate((best_d.ravel(), d)), np.concatenate((best_id.ravel(), i)), np.concatenate((np.repeat(np.arange(n), nearest), q))
    order = np.lexsort((i, d, q))
    pick = order[np.searchsorted(q[order], np.arange(n))[:, None] + np.arange(nearest)]
    return d[pick], i[pick]


def _blocks(rows: DataFrame, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of the query set: number of the first query, ids, vectors."""
    ids, vectors, number = [], [], 0
    for r in rows.toLocalIterator():
        v = np.array([np.nan if x is None else x for x in r[1]], np.float64)
        if np.isfinite(v).all() and v.any():
            ids.append(r[0])
            vectors.append(v)
        if len(ids) == QUERY_BLOCK:
            yield number, np.array(ids), np.array(vectors)
            number += len(ids)
            ids, vectors = [], []
    if ids:
        yield number, np.array(ids), np.array(vectors)


def nearest_neighbours(vectors: DataFrame, query: str, nearest: int = NEAREST, tables: int = TABLES, n_probes: int = PROBES, seed: int = SEED, polytopes: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the nearest rows found for
    each row that the condition ``query`` holds for.

    Rows whose id or vector is null, whose vector is zero, holds a null or a non-finite component, or
    has not the commonest length, take no part. Ties go to the smaller id; a row with the query's own
    id is no candidate. Repeated query rows are queries of their own. A query for which the tables
    give fewer than ``nearest`` is searched among all rows. Directions are hashed, so rows of very
    different lengths may need more probes. More ``polytopes`` a table make smaller buckets, for
    vectors with close neighbours. An empty table gives an empty result. Other columns aren't read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    lengths = rows.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    sc = rows.sparkSession.sparkContext
    schema = "__q long, query_id long, vec_id long, score double"
    dim = lengths[0].n if lengths else 0
    if not dim:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(query).where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim))

    def search(block: tuple, n: int) -> DataFrame:
        send = sc.broadcast(block)
        part = rows.transform(mapped, _search(send, dim, tables, polytopes, n, nearest, seed), schema)
        order = Window.partitionBy("__q").orderBy("score", "vec_id")
        found = checkpoint(part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= nearest))
        send.unpersist()
        return found

    # one block at a time: the driver holds one, and each block's result lies in the checkpoint folder
    done = []
    for number, ids, vecs in _blocks(asked, dim):
        found = search((number, ids, vecs), n_probes)
        full = {r[0] - number for r in found.where(F.col("rank") == nearest).select("__q").collect()}  # a block's queries at most
        if short := sorted(set(range(len(ids))) - full):  # their buckets held too little: among all rows
            again = search((0, ids[short], vecs[short]), 0)
            found = found.where(~F.col("__q").isin([number + k for k in short])).unionByName(again)
        done.append(found.select("query_id", "rank", "vec_id", "score"))
    if not done:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


QUERIES = {"op4_ann": op4_ann}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
