"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

1. Each task hashes all windows of its documents. Within a group of some MB of text a
   window that a smaller doc_id of the group also has is decided on the spot; of the
   others one entry a hash and group is sent on, so a window that a third of the
   corpus holds costs one entry a group and not one a document.
2. Entries meet by hash, in buckets whose number grows with the input, so that a task
   gets about the same whatever the corpus. The owner of a window is the smallest doc_id
   that has it; every other entry goes back to its document.
3. Documents meet their repeated windows in groups of documents, so that what is sent
   back is one row a group and task. Windows merge into maximal removal intervals, and
   the words outside of them are kept.

Buckets and groups follow the input's size and not the session's partitions, to which they
are dealt in turn; few are enough then, and the rows that are sent stay few where partitions
are many.

The hash has 64 bits: a window out of N is wrongly seen as repeated with a chance
of about N / 2**64. Entries pack 7 bytes of hash, as the bucket has the eighth. (As rows of
Spark, a hash and an id each, the entries alone take 3.5 times the input's disk.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, by_value, chunks, covered, groups, input_bytes, mapped, partitions_for, runs, table, utf8, window_hashes, word_hashes, words

WINDOW = 13
#: Buckets and groups of documents for each ``PART_BYTES`` of input, and the fewest groups.
BUCKETS_EACH, GROUPS_EACH, GROUPS_LEAST = 4, 4, 16
PART_BYTES = 16 << 20
#: Text whose windows are held at once.
GROUP_BYTES = 8 << 20
_ENTRY = pa.schema([("__bucket", pa.int32()), ("__to", pa.int32()), ("__blob", pa.binary())])
_FLAG = pa.schema([("__to", pa.int32()), ("__local", pa.bool_()), ("__blob", pa.binary())])


def _group_of(ids: np.ndarray, groups_: int) -> np.ndarray:
    """The group of documents that an id belongs to; ``_group_column`` is the same in Spark."""
    return np.mod(ids ^ (ids >> 7) ^ (ids >> 17), groups_).astype(np.int32)


def _group_column(name: str, groups_: int):
    c = F.col(name)
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 7)).bitwiseXOR(F.shiftright(c, 17)), F.lit(groups_).cast("long")).cast("int")


def _windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: window hashes, their first word in the document, their row; and each row's words."""
    offsets, data = utf8(column)
    out, counts = [], np.zeros(len(column), np.int64)
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        starts, ends, at = words(raw, at, NON_SPACE)
        h, first, doc = window_hashes(word_hashes(raw, starts, ends), at, size)
        counts[a:b] = np.diff(at)
        out.append((h, (first - at[doc]).astype(np.int32), (doc + a).astype(np.int32)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), counts
    return *(np.concatenate(x) for x in zip(*out, strict=True)), counts


def _entries(size: int, to_groups: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in groups(batches, 2, GROUP_BYTES):
            rows = pa.Table.from_batches([batch]).filter(pa.compute.is_valid(batch.column(0))).sort_by("__doc").combine_chunks()
            if not rows.num_rows:
                continue
            ids = rows.column("__doc").to_numpy()
            texts = rows.column("__text").to_numpy()
            h, _, row, _ = _windows(rows.column("__words"), size)
            order = np.argsort(h, kind="stable")  # rows ascend by doc_id, so the first of a hash is its smallest
            hs, rs = h[order], row[order]
            new = np.ones(len(hs), bool)
            new[1:] = hs[1:] != hs[:-1]
            owner = ids[rs[new]][np.cumsum(new) - 1] if len(hs) else np.zeros(0, np.int64)
            local = np.zeros(len(h), bool)
            local[order] = ids[rs] > owner
            if local.any():
                to, blobs = _local(local, row, ids, texts, to_groups)
                # these rows are decided: they only pass through, dealt out by their group
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(to), pa.array(blobs, pa.binary())], schema=_ENTRY)
            hs, docs = hs[new], ids[rs[new]]
            bucket = (hs & np.uint64(buckets - 1)).astype(np.int32)
            order = np.lexsort((docs, bucket))
            hs, docs, bucket = hs[order] >> np.uint64(8), docs[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            found, blobs = [], []
            for x, y in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(hs)])), strict=True):
                if x < y:
                    found.append(bucket[x])
                    blobs.append(_pack(hs[x:y], docs[x:y], squeeze))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.nulls(len(found), pa.int32()), pa.array(blobs, pa.binary())], schema=_ENTRY)

    return run


def _local(local: np.ndarray, row: np.ndarray, ids: np.ndarray, texts: np.ndarray, to_groups: int) -> tuple[np.ndarray, list[bytes]]:
    """For each group of documents: (id, text hash, number of runs, runs of flagged windows) one after another."""
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    rows = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(local)))[bounds]))
    to = _group_of(ids[rows], to_groups)
    out: dict[int, list] = {}
    for r, g in zip(rows.tolist(), to.tolist(), strict=True):
        found = runs(local[bounds[r] : bounds[r + 1]])
        out.setdefault(g, []).append(np.concatenate(([ids[r], texts[r], len(found)], found.ravel())).astype(np.int64))
    return np.array(list(out), np.int32), [np.concatenate(x).tobytes() for x in out.values()]


def _pack(hs: np.ndarray, docs: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Entries sorted by document: how many, the squeezed doc_id steps, and seven bytes a hash."""
    steps = np.diff(docs, prepend=0)
    if len(steps) and steps[1:].max(initial=0) < 1 << 16:
        head = squeeze.compress(np.concatenate((docs[:1].view(np.uint16), steps[1:].astype(np.uint16))).tobytes())
        kind = 1
    else:
        head, kind = squeeze.compress(docs.tobytes()), 0
    low = hs.view(np.uint8).reshape(-1, 8)[:, :7]
    return np.array([kind, len(hs), len(head)], np.int64).tobytes() + head + low.tobytes()


def _unpack(blob: memoryview) -> tuple[np.ndarray, np.ndarray]:
    kind, n, size = np.frombuffer(blob, np.int64, 3)
    head = zstandard.ZstdDecompressor().decompress(blob[24 : 24 + size])
    if kind:
        steps = np.frombuffer(head, np.uint16)
        docs = np.cumsum(np.concatenate((steps[:4].copy().view(np.int64), steps[4:].astype(np.int64))))
    else:
        docs = np.frombuffer(head, np.int64)
    hs = np.zeros((n, 8), np.uint8)
    hs[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 24 + size).reshape(-1, 7)
    return hs.view(np.uint64).ravel(), docs


def _owners(to_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sends back each window whose owner is another document; what is decided passes through."""
        hs, docs = [], []
        for batch in batches:
            decided = pa.compute.is_valid(batch.column(1))
            if passed := batch.filter(decided):
                yield pa.RecordBatch.from_arrays([passed.column(1), pa.array([True] * len(passed)), passed.column(2)], schema=_FLAG)
            rest = batch.filter(pa.compute.invert(decided))
            for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(2), strict=True):
                h, d = _unpack(memoryview(blob.as_buffer()))
                hs.append((h << np.uint64(8)) | np.uint64(bucket & 255))
                docs.append(d)
        if hs:
            yield from _sent(hs, docs, to_groups)

    return run


def _sent(hs: list, docs: list, to_groups: int) -> Iterator[pa.RecordBatch]:
    """For each group of documents: how many ids, the ids, how many hashes each, the hashes."""
    h, d = np.concatenate(hs), np.concatenate(docs)
    hs.clear(), docs.clear()
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    single = new.copy()
    single[:-1] &= new[1:]  # alone with its hash: nothing to send back
    h, order, new = h[~single], order[~single], new[~single]
    d = d[order]
    at = np.flatnonzero(new)
    back = d > np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(d)))) if len(at) else np.zeros(0, bool)
    h, d = h[back], d[back]
    to = _group_of(d, to_groups)
    order = np.lexsort((d, to))
    h, d, to = h[order], d[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    groups_, blobs = [], []
    for x, y in zip(np.concatenate(([0], cuts)), np.append(cuts, len(to)), strict=True):
        if x < y:
            ids, counts = np.unique(d[x:y], return_counts=True)
            groups_.append(to[x])
            blobs.append(np.concatenate(([len(ids)], ids, counts, h[x:y].view(np.int64))).astype(np.int64).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(groups_, pa.int32()), pa.array([False] * len(blobs)), pa.array(blobs, pa.binary())], schema=_FLAG)


def _remove(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, flags before documents; flags are dropped with their group."""
        sent: dict[int, list] = {}
        local: dict[tuple[int, int], np.ndarray] = {}
        for part in groups(batches, 5, GROUP_BYTES // 2):
            last = part.column(0)[-1].as_py()
            flags = part.filter(pa.compute.equal(part.column(1), 0))
            for of_local, blob, group in zip(flags.column(2).to_pylist(), flags.column(6), flags.column(0).to_pylist(), strict=True):
                _read(np.frombuffer(blob.as_buffer(), np.int64), of_local, group, sent, local)
            part = part.filter(pa.compute.equal(part.column(1), 1))
            h, _, row, counts = _windows(part.column(5), size)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            kept, gone, cuts = [], [], []
            for i, (doc, key, text) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5), strict=True)):
                found = text.as_buffer().to_pybytes().split() if text.is_valid else []
                mine = h[bounds[i] : bounds[i + 1]]
                hit = np.zeros(len(mine), bool)
                if doc is not None and len(mine):
                    for x, y in local.get((doc, key), (0, ()))[1]:
                        hit[x:y] = True
                    if doc in sent:
                        hit |= np.isin(mine, np.concatenate(sent[doc][1]))
                if hit.any():
                    mask = covered(np.flatnonzero(hit), size, len(found))
                    kept.append(b" ".join([w for w, m in zip(found, mask.tolist(), strict=True) if not m]).decode())
                    gone.append(int(mask.sum()))
                    cuts.append(runs(mask).tolist())
                else:
                    kept.append(b" ".join(found).decode())
                    gone.append(0)
                    cuts.append([])
            sent, local = {k: v for k, v in sent.items() if v[0] == last}, {k: v for k, v in local.items() if v[0] == last}
            yield pa.RecordBatch.from_arrays([part.column(3), pa.array(counts), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(cuts, schema.field(4).type)], schema=schema)

    return run


def _read(blob: np.ndarray, of_local: bool, group: int, sent: dict, local: dict) -> None:
    if of_local:
        at = 0
        while at < len(blob):
            doc, key, n = blob[at : at + 3].tolist()
            local.setdefault((doc, key), (group, blob[at + 3 : at + 3 + 2 * n].reshape(-1, 2).tolist()))
            at += 3 + 2 * n
    else:
        n = int(blob[0])
        hashes = blob[1 + 2 * n :].view(np.uint64)
        ends = np.cumsum(blob[1 + n : 1 + 2 * n])
        for doc, start, end in zip(blob[1 : 1 + n].tolist(), np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            sent.setdefault(doc, (group, []))[1].append(hashes[start:end])


def substring_dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed ([start, end) word intervals) of each row.

    A word goes if a window of ``size`` words of one document covers it whose words
    also start in a document with a smaller id; windows are judged on the input.
    Null or empty text: no words. Null id: compared with nothing, kept whole.
    Repeated ids: not smaller than each other, so rows of one id never remove one
    another. Other columns play no part. An empty table gives an empty result.
    """
    parts = partitions_for(docs, PART_BYTES)
    in_bytes = input_bytes(docs)
    sized = parts if in_bytes >= 1 << 53 else min(parts, max(1, -(-in_bytes // PART_BYTES)))
    to_groups, buckets = max(GROUPS_LEAST, GROUPS_EACH * sized) + 1, max(256, 1 << (BUCKETS_EACH * sized - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__words"))
    found = rows.select(F.col("doc_id").alias("__doc"), "__text", "__words").transform(mapped, _entries(size, to_groups, buckets), "__bucket int, __to int, __blob binary")
    flags = found.repartitionById(parts, "__bucket").transform(mapped, _owners(to_groups), "__to int, __local boolean, __blob binary")
    no = lambda kind: F.lit(None).cast(kind)
    flags = flags.select("__to", F.lit(0).alias("__kind"), "__local", no("long").alias("doc_id"), no("long").alias("__text"), no("string").alias("__words"), "__blob")
    texts = rows.where("doc_id is not null").select(_group_column("doc_id", to_groups).alias("__to"), F.lit(1).alias("__kind"), no("boolean").alias("__local"), "doc_id", "__text", "__words", no("binary").alias("__blob"))
    met = flags.union(texts).repartitionById(parts, "__to").sortWithinPartitions("__to", "__kind")
    # rows without an id have nothing to meet and stay where they are
    alone = rows.where("doc_id is null").select(F.lit(0).alias("__to"), F.lit(1).alias("__kind"), no("boolean").alias("__local"), "doc_id", "__text", "__words", no("binary").alias("__blob"))
    return met.union(alone).transform(mapped, _remove(size), "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN own USING (k) WHERE o < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, count(hit.p) AS g, coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE hit.p IS NULL), '') AS t
         FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
}

by_value(__name__)
