"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs of every document fall into a fixed number of hash buckets. The raw
model counts all documents, the target model a bounded sample of those labelled as good.
A document's weight is the sum of the smoothed log(target / raw) over all its n-grams, brought
down to the weight of ``LENGTH`` n-grams where it has more. Keys of weight plus
Gumbel noise are compared, which draws without replacement in proportion to the weights;
the k-th key is found by radix selection on the keys' bits, with a fixed number of counts
sent to the driver, so neither k nor the corpus gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, by_value, checkpoint, chunks, mapped, mix, table, utf8, word_hashes, words

BUCKETS = 1 << 18
#: Labelled target rows that the target model is fitted on, at most.
TARGET_ROWS = 20_000
#: Share of the rows that a sample keeps.
KEEP = 0.8
#: Added to the target count and to what the raw model expects of it: every bucket counts, a rare one little.
PRIOR = 5.0
#: A longer document weighs as if it had so many n-grams of its own mean ratio; else chance would add up in it.
LENGTH = 200


def _buckets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of rows: the buckets of all words and word pairs, and their rows."""
    offsets, data = utf8(column)
    for a, b in chunks(offsets):
        starts, ends, at = words(raw := LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], ALNUM)
        h = word_hashes(raw, starts, ends)
        row = np.repeat(np.arange(a, b), np.diff(at))
        same = row[1:] == row[:-1]
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
        yield a, b, (np.concatenate((h, pairs)) % np.uint64(size)).astype(np.int64), np.concatenate((row, row[:-1][same] if len(row) else row))


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for _, _, bucket, row in _buckets(batch.column(0), size):
                raw += np.bincount(bucket, minlength=size)
                if (mine := good[row]).any():
                    target += np.bincount(bucket[mine], minlength=size)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def _weigh(send, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for _, _, bucket, row in _buckets(batch.column(0), size):
                total += np.bincount(row, send.value[bucket], batch.num_rows)
                n += np.bincount(row, minlength=batch.num_rows)
            total *= np.minimum(1, LENGTH / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(total)], names=[*batch.schema.names[1:], "n_grams", "log_weight"])

    return run


def log_ratios(docs: DataFrame, good: DataFrame, size: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log(target / raw) of each bucket. ``good`` has the doc_id of target documents; of these the
    ``target_rows`` with the smallest hashes are used, so few that they are broadcast."""
    picked = good.select(F.col("doc_id").cast("long").alias("__good")).where("__good is not null").distinct().orderBy(F.xxhash64("__good"), "__good").limit(target_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__good"), "left")
    counted = rows.select("text", F.col("__good").isNotNull().alias("good")).transform(mapped, _count(size), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for r in counted.collect():  # a row a bucket at most
        raw[r.bucket], target[r.bucket] = r.raw, r["target"]
    if not target.sum():
        return np.zeros(size)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> int | None:
    """The k-th largest value of a long column, 16 bits at a time; None if k exceeds the rows."""
    # flipping the sign bit's meaning: shifted values compare as unsigned
    top, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(column, shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
        if shift == 48:
            digit = digit.bitwiseXOR(F.lit(0x8000))
        rows = keys if shift == 48 else keys.where(F.shiftright(column, shift + 16) == F.lit(top))
        counts = sorted(((r["d"], r["n"]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if n >= left:
                break
            left -= n
        else:
            return None
        d = (d ^ 0x8000) if shift == 48 else d
        top = (top << 16 | d) if shift != 48 else (d - 0x10000 if d & 0x8000 else d)
    return top


def resample(docs: DataFrame, good: DataFrame, keep: float = KEEP, seed: int = 42, size: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, n_grams, log_weight and key of the round(keep * rows) rows that a draw without
    replacement takes, with chances in proportion to the weights.

    The noise follows from doc_id, text and seed alone, so a draw can be repeated. Null or empty texts
    have no n-grams and log weight 0; very long ones weigh as ``LENGTH`` n-grams. Equal keys at the
    border are ordered by doc_id (nulls last), then as the rows come: the draw has its exact size
    however many rows are alike. Without target rows all weights are 0 and the draw is uniform. An
    empty table gives an empty draw. Only doc_id and text are read, whatever other columns are called.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, good, size, target_rows))
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__text"))
    weighed = rows.transform(mapped, _weigh(ratios, size), "doc_id long, __text long, n_grams long, log_weight double")
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "__text"), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(even)))
    # longs that sort as the key, to a millionth, and as what comes next; the checkpoint makes row numbers lasting
    order = ["__sort", "__id", "__row"]
    sortable = checkpoint(noisy.select("doc_id", "n_grams", "log_weight", "key", F.round(F.col("key") * 1e6).cast("long").alias("__sort"), (-F.coalesce("doc_id", F.lit(2**62))).alias("__id"), (-F.monotonically_increasing_id()).alias("__row")))
    total = sortable.count()
    left = round(keep * total)
    if left >= total or not left:
        return sortable.where(F.lit(left > 0)).drop(*order)
    chosen, ties = F.lit(False), F.lit(True)
    for name in order:
        among = sortable.where(ties)
        border = kth_largest(among, left, name)
        left -= among.where(F.col(name) > border).count()
        chosen, ties = chosen | (ties & (F.col(name) > border)), ties & (F.col(name) == border)
    return sortable.where(chosen | ties).drop(*order)


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


QUERIES = {"op10_importance": op10_importance}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
