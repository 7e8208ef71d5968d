"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints with at most two differing bits differ in at most two of their eight bytes,
so they share at least six bytes at the same positions. A posting list of a single byte
would hold 1/256 of all fingerprints and its pairs would grow with their square, so lists
are made for four positional bytes at a time, two of the fingerprint's four quarters: two
differing bytes leave two quarters alike, so every pair to be found meets in one of the six
lists at least. The shared positional bytes of the pairs that meet are tallied, pairs under
the guaranteed six are dropped, and the rest are verified by their bits. In a list that is
long, all pairs are never formed: the bytes beyond the four are lists in turn, so that six
bytes are tallied before a pair arises. Lists of more than ``LONG`` fingerprints are dealt out
by six bytes at once, and so hold 65,536 at most. A list sends on one link a fingerprint to
the class that it belongs to there, not all pairs. Copies share one fingerprint, indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, checkpoint, chunks, mapped, partitions_for, table, utf8
from .graph import components

SHINGLE, SEED, DIFFER = 3, 42, 2
#: Bytes that two such fingerprints share at least.
SHARED = 8 - DIFFER
_SMALL = 48  # lists up to this long are compared pair by pair
#: Fingerprints of a list of four bytes that go to one task at most.
LONG = 1 << 16
_CHOICES = list(combinations(range(8), 2))  # the two positions that a list of six bytes leaves free
#: Lists by number: the positions left free. Six of four bytes, then 28 of six.
_FREE = [tuple(p for p in range(8) if p // 2 not in kept) for kept in combinations(range(4), 2)] + _CHOICES


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        out = np.zeros(batch.num_rows, np.uint64)
        for a, b in chunks(offsets, 1 << 18):
            raw = data[offsets[a] : offsets[b]].tobytes().lower()
            hashes, counts = [], []
            for x, y in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist(), strict=True):
                w = raw[x:y].split()
                if len(w) > SHINGLE:
                    hashes += [digest(b" ".join(s), SEED) for s in zip(w, w[1:], w[2:], strict=False)]
                    counts.append(len(w) - SHINGLE + 1)
                else:
                    hashes += [digest(b" ".join(w), SEED)] * bool(w)
                    counts.append(int(bool(w)))
            out[a:b] = _majority(np.array(hashes, np.uint64), np.array(counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes: the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if len(rows):
        at = np.cumsum(counts[rows]) - counts[rows]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > counts[rows][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.transform(mapped, _fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _listed(numbers: list[int]) -> Column:
    """(choice, shared) of a fingerprint's lists: the number, and the fingerprint without the free bytes."""
    masks = [~sum(0xFF << 8 * p for p in _FREE[k]) & (2**64 - 1) for k in numbers]
    return F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared")) for k, m in zip(numbers, masks, strict=True)])


def _postings(nodes: DataFrame, long: int = LONG) -> DataFrame:
    """(choice, shared, fp): the lists of each fingerprint; long lists of four bytes are lists of six instead."""
    flat = lambda df, numbers: df.select("fp", F.explode(_listed(numbers)).alias("of")).select("of.choice", "of.shared", "fp")
    lists = flat(nodes, list(range(6)))
    if nodes.count() <= long:
        return lists
    heavy = lists.groupBy("choice", "shared").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("choice").alias("__c"), F.col("shared").alias("__s"))
    heavy = checkpoint(heavy)
    if heavy.isEmpty():
        return lists
    same = (F.col("choice") == F.col("__c")) & (F.col("shared") == F.col("__s"))
    members = lists.join(heavy, same, "left_semi").select("fp").distinct()
    return lists.join(heavy, same, "left_anti").unionByName(flat(members, list(range(6, len(_FREE)))))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list: links each fingerprint with the first of its class within the list."""
    held: list[tuple] = []  # the last list may go on in the next batch
    for batch in batches:
        choice, shared, fp = (c.to_numpy() for c in batch.columns)
        if not len(fp):
            continue
        if held and (held[0][0][-1], held[0][1][-1]) == (choice[-1], shared[-1]):
            held.append((choice, shared, fp))
            continue
        last = np.flatnonzero((choice != choice[-1]) | (shared != shared[-1]))
        cut = last[-1] + 1 if len(last) else 0
        yield from _linked(*(np.concatenate(x) for x in zip(*held, (choice[:cut], shared[:cut], fp[:cut]), strict=True)))
        held = [(choice[cut:], shared[cut:], fp[cut:])]
    if held:
        yield from _linked(*(np.concatenate(x) for x in zip(*held, strict=True)))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair of fingerprints shares."""
    return ((a ^ b)[:, None].view(np.uint8) == 0).sum(1)


def _retained(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share the guaranteed minimum of bytes, and of these the ones whose bits verify."""
    enough = tally(fp[a], fp[b]) >= SHARED
    a, b = a[enough], b[enough]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= DIFFER
    return a[near], b[near]


def _short(of: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs retained within lists of ``_SMALL`` at most; ``of`` ascends."""
    out = []
    for o in range(1, _SMALL):
        same = np.flatnonzero(of[o:] == of[:-o]) if len(of) > o else []
        if not len(same):
            break
        out.append(_retained(fp, same, same + o))
    return out


def _within(fp: np.ndarray, free: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs retained within one long list: by lists of all its bytes but two of the free ones."""
    out = []
    for i, j in combinations(free, 2):
        key = fp & np.uint64(~((0xFF << 8 * i) | (0xFF << 8 * j)) & (2**64 - 1))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(fp), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        of = np.cumsum(new) - 1
        sizes = np.bincount(of)
        small = np.flatnonzero((sizes[of] > 1) & (sizes[of] <= _SMALL))
        out += [(order[small[a]], order[small[b]]) for a, b in _short(of[small], fp[order[small]])]
        at = np.flatnonzero(new)
        for k in np.flatnonzero(sizes > _SMALL):
            mine = order[at[k] : at[k] + sizes[k]]
            x, y = np.uint64(8 * i), np.uint64(8 * j)
            bits = (((fp[mine] >> x) & np.uint64(255)) | (((fp[mine] >> y) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
            place = np.full(1 << 16, -1, np.int64)
            place[bits] = mine
            for mask in _FLIPS:
                other = place[bits ^ mask]
                here = other >= 0
                out.append((mine[here], other[here]))
    return out


def _linked(choice: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(fp) < 2:
        return
    fp = fp.view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1])
    of = np.cumsum(new) - 1
    sizes = np.bincount(of)
    small = np.flatnonzero((sizes[of] > 1) & (sizes[of] <= _SMALL))
    found = [(small[a], small[b]) for a, b in _short(of[small], fp[small])]
    at = np.flatnonzero(new)
    for k in np.flatnonzero(sizes > _SMALL):
        found += [(at[k] + a, at[k] + b) for a, b in _within(fp[at[k] : at[k] + sizes[k]], _FREE[choice[at[k]]])]
    if not found:
        return
    label = _least(len(fp), *(np.concatenate(x) for x in zip(*found, strict=True)))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], names=["a", "b"])


_FLIPS = [1 << x for x in range(16)] + [1 << x | 1 << y for x, y in combinations(range(16), 2)]


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def simhash_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links, of each row.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id
    takes part in its fingerprint but names no component (component_id is null where no row
    of the component has an id). Repeated rows each get their row; an empty table an empty
    result. Only doc_id and text are read.
    """
    fps = checkpoint(fingerprints(docs))
    return _classes(fps, partitions_for(docs))


def _classes(fps: DataFrame, parts: int, long: int = LONG) -> DataFrame:
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = _postings(nodes, long).repartition(parts, "choice", "shared").sortWithinPartitions("choice", "shared").transform(mapped, _links, "a long, b long")
    links = checkpoint(links.distinct())
    found = components(links)
    rooted = checkpoint(nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("__fp"), "first", F.coalesce("label", "fp").alias("__root")))
    least = checkpoint(rooted.groupBy("__root").agg(F.min("first").alias("component_id")).withColumnRenamed("__root", "__of"))
    classes = checkpoint(rooted.join(least, F.col("__root") == F.col("__of")).select("__fp", "component_id"))
    return fps.join(classes, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged: that of the smallest doc_id. Of several rows of
    that id it is the one whose text hash is smallest (equal texts are one another's copies, so any of
    them will do). Rows with a null doc_id can't be named and all stay."""
    kept = simhash_classes(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__n"))
    named = docs.where("doc_id is not null")
    one = named.join(kept, named["doc_id"].cast("long") == F.col("__kept"))
    alone = one.where("__n = 1").select(*docs.columns)
    first = Window.partitionBy("__kept").orderBy(F.xxhash64("text"))
    several = one.where("__n > 1").withColumn("__first", F.row_number().over(first)).where("__first = 1").select(*docs.columns)
    return alone.unionByName(several).unionByName(docs.where("doc_id is null"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
