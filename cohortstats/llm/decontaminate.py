"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a chunk of documents. Its suffix array holds the suffixes that can take
part in a match: those that start in a run of benchmark words at least as long as the
shortest item window, sorted by their first ``size`` words. Every test suffix is
binary-searched in every shard; the two neighbours of its place give its longest
verbatim match, the equal range all occurrences. The benchmark travels to the
executors in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents a
block, so what is sent at once does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, by_value, chunks, covered, mapped, runs, table, utf8, word_hashes, words

SIZE = 10
BLOCK_BYTES = 8 << 20

_MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"


def _tests(rows: list, size: int) -> dict:
    """Vocabulary, suffixes and windows of one block of the benchmark."""
    column = pa.array([r.text for r in rows], pa.string())
    offsets, data = utf8(column)
    data = LOWER[data]
    starts, ends, at = words(data, offsets, ALNUM)
    vocabulary, ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    counts = np.diff(at)
    item = np.repeat(np.arange(len(rows)), counts)
    left = np.repeat(at[1:], counts) - np.arange(len(ids))  # words from here to the end of the item
    need = np.minimum(size, counts)  # a short item is one window
    window = (left >= need[item]) if len(ids) else np.zeros(0, bool)
    suffixes = np.full((len(ids), size), -1, np.int32)
    for k in range(size):
        here = left > k
        suffixes[here, k] = ids[np.flatnonzero(here) + k]
    return {
        "vocabulary": vocabulary, "suffixes": suffixes, "item": item, "place": np.arange(len(ids)) - at[:-1][item] if len(ids) else item,
        "need": np.where(window, need[item], 0) if len(ids) else item, "shortest": int(need[need > 0].min(initial=size)), "names": [r.item_id for r in rows],
    }


def _suffix_array(ids: np.ndarray, at: np.ndarray, size: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that can match, in the order of their first words; and those words."""
    known = ids >= 0
    # how many benchmark words follow from here within the document
    stop = np.append(np.flatnonzero(~known), len(ids))
    ends = np.repeat(at[1:], np.diff(at))
    reach = np.minimum(stop[np.searchsorted(stop, np.arange(len(ids)))], ends) - np.arange(len(ids)) if len(ids) else ids
    places = np.flatnonzero(reach >= shortest)
    first = np.full((len(places), size), -1, np.int32)
    for k in range(size):
        here = reach[places] > k
        first[here, k] = ids[places[here] + k]
    order = np.lexsort(first.T[::-1])
    return places[order], first[order]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the rows of a and b begin with alike."""
    same = (a == b) & (a >= 0)
    return np.where(same.all(1), a.shape[1], np.argmin(same, 1))


def _bounds(array: np.ndarray, tests: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each test suffix's first ``lengths`` words: its range in the suffix array."""
    size = array.shape[1]
    within = np.arange(size) < lengths[:, None]

    def search(right: bool) -> np.ndarray:
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(array))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            found = array[np.minimum(mid, len(array) - 1)]
            differs = (found != tests) & within
            first = np.argmax(differs, 1)
            rows = np.arange(len(tests))
            below = np.where(differs.any(1), found[rows, first] < tests[rows, first], right)
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low

    return search(False), search(True)


def _found(column: pa.Array, t: dict) -> Iterator[tuple[int, int, np.ndarray, tuple | None]]:
    """For each shard: its rows, where each one's words begin, and its matches (place, row, test suffix, words)."""
    windows = np.flatnonzero(t["need"])
    tests, need = t["suffixes"][windows], t["need"][windows]
    offsets, data = utf8(column)
    for a, b in chunks(offsets):
        raw = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, at = words(raw, offsets[a : b + 1] - offsets[a], ALNUM)
        h = word_hashes(raw, starts, ends)
        ids = np.full(len(h), -1, np.int64)
        if len(t["vocabulary"]):
            place = np.minimum(np.searchsorted(t["vocabulary"], h), len(t["vocabulary"]) - 1)
            ids = np.where(t["vocabulary"][place] == h, place, -1)
        places, array = _suffix_array(ids, at, t["suffixes"].shape[1], t["shortest"])
        got = None
        if len(places) and len(tests):
            low, high = _bounds(array, tests, need)
            per = high - low
            of = np.repeat(np.arange(len(tests)), per)
            found = places[np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per) + low[of]]
            if len(found):
                got = found, np.searchsorted(at, found, "right") - 1, windows[of], need[of]
        yield a, b, at, got


def _search(send):
    longest_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    schema = pa.schema([("__id", pa.int64()), ("__key", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", longest_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = send.value
        for batch in batches:
            for a, b, at, got in _found(batch.column(2), t):
                rows = b - a
                hit, items, longest = [[] for _ in range(rows)], [set() for _ in range(rows)], [[] for _ in range(rows)]
                if got:
                    found, doc, suffix, need = got
                    mask = covered(found, need, at[-1])
                    for d, i in set(zip(doc.tolist(), t["item"][suffix].tolist(), strict=True)):
                        items[d].add(t["names"][i])
                    for d in np.unique(doc):
                        hit[d] = runs(mask[at[d] : at[d + 1]]).tolist()
                    for d, m in _longest(found, doc, suffix, need, t, at):
                        longest[d].append(m)
                part = batch.slice(a, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array(hit, schema.field(3).type), pa.array([sorted(x) for x in items], schema.field(4).type), pa.array(longest, longest_type)], schema=schema)

    return run


def _keep(send, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, _, got in _found(batch.column(column), send.value):
                if got:
                    clean[a + got[1]] = False
            yield batch.filter(pa.array(clean))

    return run


def _longest(found: np.ndarray, doc: np.ndarray, suffix: np.ndarray, need: np.ndarray, t: dict, at: np.ndarray) -> Iterator[tuple[int, dict]]:
    """Chains of windows one word apart in item and document alike are one maximal verbatim match."""
    place, item = t["place"][suffix], t["item"][suffix]
    order = np.lexsort((found, found - place, item))
    f, p, i, n, d = found[order], place[order], item[order], need[order], doc[order]
    new = np.ones(len(f), bool)
    new[1:] = (i[1:] != i[:-1]) | (f[1:] != f[:-1] + 1) | (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(f)) - 1
    for x, y in zip(first.tolist(), last.tolist(), strict=True):
        yield int(d[x]), {"item_id": t["names"][i[x]], "item_start": int(p[x]), "doc_start": int(f[x] - at[d[x]]), "length": int(f[y] - f[x] + n[y])}


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows in groups of bounded bytes, one group at a time on the driver."""
    got, size = [], 0
    for row in benchmark.toLocalIterator():
        got.append(row)
        size += len(row.text.encode())
        if size >= BLOCK_BYTES:
            yield got
            got, size = [], 0
    if got:
        yield got


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document row: doc_id, __key (a hash of the text), n_words, hit ([start, end) word
    intervals), items (item_ids, sorted as strings) and longest (maximal verbatim matches).

    Words are lower-cased (A-Z) runs of digits, letters and characters past ASCII. Null or
    empty texts have no words; an item without words never matches, nor does one whose id is
    null have a name to report (it is left out). Repeated document rows each get their row.
    An empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))
    schema = f"__id long, __key long, n_words long, hit array<array<long>>, items array<string>, longest {_MATCH}"
    parts = []
    for block in _blocks(_items(benchmark)):
        parts.append(rows.transform(mapped, _search(spark.sparkContext.broadcast(_tests(block, size))), schema))
    if len(parts) <= 1:
        block = parts[0] if parts else rows.transform(mapped, _search(spark.sparkContext.broadcast(_tests([], size))), schema)
        return block.withColumnRenamed("__id", "doc_id")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # one row a block of each document row: equal rows (same id and text) stay as many as they were
    merged = out.groupBy("__id", "__key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("longest")).alias("longest"), (F.count("*") / len(parts)).cast("int").alias("__n"),
    )
    return merged.select(F.explode(F.sequence(F.lit(1), "__n")).alias("__i"), F.col("__id").alias("doc_id"), "__key", "n_words", _merged("hit").alias("hit"), "items", "longest").drop("__i")


def _merged(name: str):
    """Sorted intervals with those that overlap joined."""
    return F.expr(
        f"""aggregate(array_sort({name}), cast(array() as array<array<long>>),
        (done, x) -> if(size(done) > 0 and element_at(done, -1)[1] >= x[0],
            concat(slice(done, 1, size(done) - 1), array(array(element_at(done, -1)[0], greatest(element_at(done, -1)[1], x[1])))), concat(done, array(x))))"""
    )


def n_hit(column: str = "hit"):
    return F.expr(f"aggregate({column}, 0L, (n, x) -> n + x[1] - x[0])")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text holds no benchmark window; nothing is
    shuffled. Null texts have no words and stay, as do rows with a null id."""
    for block in _blocks(_items(benchmark)):
        send = docs.sparkSession.sparkContext.broadcast(_tests(block, size))
        docs = docs.transform(mapped, _keep(send, docs.columns.index(text_col)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


QUERIES = {"op5_decontaminate": op5_decontaminate}

ORACLE_SQL = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS k
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, sizes)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
}

by_value(__name__)
