"""Personal data by bootstrapped contextual extraction.

Patterns of form (e-mail, address, card and phone numbers) find seed entities in every
whole text. The words around seeds induce lexical patterns: the two words before, or the
word before and the word after. A second pass counts all that stands in the slots of the
induced patterns: a slot holds the whole seed that begins there, or neighbouring words
with digits, or one word. Spark then scores the graph of patterns and instances: a pattern
is worth the share of its slots that hold believed instances, an instance is believed as
far as the patterns that it stands in are. A third pass reads the slots of the confident
patterns. Words of any form there count as far as their patterns do, times the share of
the word's occurrences in the corpus that stand in such slots: ordinary words occur
elsewhere, names that are only ever written there don't. What is believed is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, by_value, checkpoint, chunks, mapped, mix, table, utf8, word_hashes, words

KINDS = ("email", "ip", "card", "phone", "found")
#: Distinct seeds that induce a pattern, patterns or words sent at a time (8 bytes each; one pass over the
#: texts a block), rounds of scoring, and what a pattern and an instance must reach.
MIN_SEEDS, PATTERNS, ROUNDS, CONFIDENT, BELIEVED = 5, 1_000_000, 3, 0.8, 0.8

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive: where these fail, no shorter run or later start within the run could match
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
_WORD_FORM = np.arange(256, dtype=np.uint8)
_WORD_FORM[65:91] += 32
_WORD_FORM[48:58] = 48
_AROUND = b"()[]{}<>.,;:!?\"'`*#$%&"
_INNER = np.ones(256, bool)
_INNER[list(_AROUND)] = False
#: Neighbouring words with digits are one identifier up to this many digits (those of the longest card).
_DIGITS = 19


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find(b"@", max(at + 1, done))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) in bytes; leftmost, not overlapping within a kind; sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if b"@" in text else []
    for m in _IP.finditer(text):
        first = text[m.start() : m.start(1) - 1]
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in (first, *m.groups())):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().translate(None, b" -")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _contexts(h: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two patterns of each slot of words first..last in a document of words low..high; 0 where words lack."""

    def at(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (k >= low) & (k < high)
        return h[np.where(inside, k, 0)], inside

    (b, has_b), (a, has_a), (c, has_c) = at(first - 1), at(first - 2), at(last + 1)
    left = mix(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) | np.uint64(1)
    both = mix(b * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xD1342543DE82EF95) + np.uint64(2)) | np.uint64(1)
    return np.where(has_a & has_b, left, 0).astype(np.uint64), np.where(has_b & has_c, both, 0).astype(np.uint64)


def _instance(text: bytes) -> int:
    """Hash of an entity as it is compared: its letters and digits, lower case."""
    plain = re.sub(rb"[^a-z0-9@.\x80-\xff]", b"", text.lower())
    h = word_hashes(np.frombuffer(plain, np.uint8), np.array([0]), np.array([len(plain)]))[0]
    return int(h.view(np.int64))


def _pieces(column: pa.Array):
    """For each chunk: first row, row bounds in bytes, bytes, word starts and ends, first words of rows, hashes."""
    offsets, data = utf8(column)
    for a, b in chunks(offsets):
        raw = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        yield a, at, raw


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
    seeds_type = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64())]))
    for batch in batches:
        spans, seeds = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for a, at, raw in _pieces(batch.column(2)):
            marks = np.concatenate(([0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))))[at]
            for k in np.flatnonzero(np.diff(marks)).tolist():
                text = raw[at[k] : at[k + 1]].tobytes()
                found = base_spans(text)
                if not found:
                    continue
                own = np.frombuffer(text, np.uint8)
                points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                spans[a + k] = [{"start": int(points[s]), "rank": r, "end": int(points[e])} for s, r, e in found]
                starts, ends, bounds = words(own, np.array([0, len(own)]), NON_SPACE)
                h = word_hashes(_WORD_FORM[own], starts, ends)
                first = np.searchsorted(starts, [s for s, _, _ in found], "right") - 1
                last = np.searchsorted(ends, [e for _, _, e in found], "left")
                low, high = np.zeros(len(found), int), np.full(len(found), len(h))
                for pattern in _contexts(h, first, last, low, high):
                    for p, (s, _, e), f in zip(pattern.view(np.int64).tolist(), found, first.tolist(), strict=True):
                        if p and not text[starts[f] : s].strip(_AROUND):  # the entity begins its word
                            seeds[a + k].append({"pattern": p, "instance": _instance(text[s:e])})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(seeds, seeds_type)], names=["doc_id", "__key", "base", "seeds"])


class _Fills:
    """The words of a chunk of texts as fillings of slots: where each ends, and which are like identifiers."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        self.starts, self.ends, self.bounds = words(raw, at, NON_SPACE)
        self.h = word_hashes(_WORD_FORM[raw], self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.bounds))
        self.digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
        ats = np.concatenate(([0], np.cumsum(raw == 64)))
        self.numeric = self.digits[self.ends] > self.digits[self.starts]
        self.marked = self.numeric | (ats[self.ends] > ats[self.starts])
        self.last = np.arange(len(self.h))
        grow = np.flatnonzero(self.numeric)
        while len(grow):  # as long as the next word has digits, too, and there aren't too many
            to = self.last[grow] + 1
            good = to < self.bounds[self.doc[grow] + 1]
            grow, to = grow[good], to[good]
            good = self.numeric[to] & (self.digits[self.ends[to]] - self.digits[self.starts[grow]] <= _DIGITS)
            grow = grow[good]
            self.last[grow] += 1
        self.like = (self.digits[self.ends[self.last]] - self.digits[self.starts] >= 4) | (ats[self.ends] > ats[self.starts])
        self.inside = np.zeros(len(self.h), bool)
        self.seeds: dict[int, tuple[int, int]] = {}
        self.taken = np.zeros(len(raw) + 1, np.int32)  # bytes of base spans before each byte

    def place_seeds(self, docs: np.ndarray) -> None:
        """Words that begin a seed stand for all of it; its other words fill nothing."""
        change = np.zeros(len(self.raw) + 1, np.int32)
        for k in docs.tolist():
            zero, low, high = int(self.at[k]), int(self.bounds[k]), int(self.bounds[k + 1])
            text = self.raw[zero : self.at[k + 1]].tobytes()
            for s, _, e in base_spans(text):
                change[zero + s] += 1
                change[zero + e] -= 1
                f = low + int(np.searchsorted(self.starts[low:high], zero + s, "right")) - 1
                if text[self.starts[f] - zero : s].strip(_AROUND) or f in self.seeds and self.seeds[f][1] >= zero + e:
                    continue
                self.seeds[f] = zero + s, zero + e
                self.last[f] = low + int(np.searchsorted(self.ends[low:high], zero + e, "left"))
                self.like[f] = True
        for f in self.seeds:
            self.inside[f + 1 : self.last[f] + 1] = True
        self.taken[1:] = np.cumsum(np.cumsum(change[:-1]) > 0)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return _contexts(self.h, np.arange(len(self.h)), self.last, self.bounds[self.doc], self.bounds[self.doc + 1])

    def span(self, w: int) -> tuple[int, int]:
        """Bytes of the filling that begins at word w, without what stands around it."""
        if w in self.seeds:
            return self.seeds[w]
        text = self.raw[self.starts[w] : self.ends[self.last[w]]].tobytes()
        a = int(self.starts[w]) + len(text) - len(text.lstrip(_AROUND))
        return a, a + len(text.strip(_AROUND))

    def hits(self, patterns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words whose slots are of the patterns, and the patterns, for both kinds of context."""
        self.place_seeds(np.unique(self.doc[self.marked]))
        for pattern in self.contexts():
            found = np.flatnonzero(_among(pattern, patterns) & ~self.inside)
            yield found, pattern[found].view(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _cores(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in lower case without what stands around them; 0 if nothing is left."""
    inner = np.append(np.flatnonzero(_INNER[raw]), len(raw))
    a, b = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    some = b > a
    out = np.zeros(len(starts), np.uint64)
    out[some] = word_hashes(LOWER[raw], inner[a[some]], inner[b[some] - 1] + 1) | np.uint64(1)
    return out


def _long(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _slots(send):
    """How often what fills the slots of the patterns: like identifiers, one by one; other words, all in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = send.value
        for batch in batches:
            n: dict[tuple, int] = {}
            for _, at, raw in _pieces(batch.column(2)):
                fills = _Fills(raw, at)
                for found, pattern in fills.hits(patterns):
                    like = fills.like[found]
                    for p, k in zip(*np.unique(pattern[~like], return_counts=True), strict=True):
                        n[int(p), None] = n.get((int(p), None), 0) + int(k)
                    for w, p in zip(found[like].tolist(), pattern[like].tolist(), strict=True):
                        a, b = fills.span(w)
                        key = p, _instance(raw[a:b].tobytes())
                        n[key] = n.get(key, 0) + 1
            yield _long([[p for p, _ in n], [i for _, i in n], list(n.values())], ["pattern", "instance", "n"])

    return run


def _found(send):
    """What fills the slots of the patterns and is no base span, with its place; ``first`` is 0 where a place was given before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = send.value
        for batch in batches:
            rows = []
            ids, keys = batch.column(0), batch.column(1)
            for first, at, raw in _pieces(batch.column(2)):
                fills = _Fills(raw, at)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                seen = set()
                for found, pattern in fills.hits(patterns):
                    cores = _cores(raw, fills.starts[found], fills.ends[found]).view(np.int64)
                    for w, p, core in zip(found.tolist(), pattern.tolist(), cores.tolist(), strict=True):
                        a, b = fills.span(w)
                        free = fills.taken[a] == fills.taken[b]
                        if a < b and (free or not fills.like[w]):
                            like, k = bool(fills.like[w]), first + int(fills.doc[w])
                            zero = points[at[fills.doc[w]]]
                            rows.append((p, _instance(raw[a:b].tobytes()) if like else core, int(like), int(w not in seen), ids[k].as_py(), keys[k].as_py(), int(points[a] - zero) if free else None, int(points[b] - zero)))
                            seen.add(w)
            yield _long(list(zip(*rows, strict=True)) if rows else [[]] * 8, ["pattern", "instance", "like", "first", "doc_id", "__key", "start", "end"])

    return run


def _occurrences(send):
    """How often the given words occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = send.value
        for batch in batches:
            total = np.zeros(len(known), np.int64)
            for _, at, raw in _pieces(batch.column(2)):
                starts, ends, _ = words(raw, at, NON_SPACE)
                cores = _cores(raw, starts, ends)
                total += np.bincount(np.searchsorted(known, cores[_among(cores, known)]), minlength=len(known))
            some = np.flatnonzero(total)
            yield _long([known[some].view(np.int64), total[some]], ["instance", "n"])

    return run


def _in_blocks(rows: DataFrame, keys: DataFrame, size: int, run, schema: str) -> tuple[DataFrame, int] | tuple[None, int]:
    """What a pass over the rows gives for the keys (one long column), ``size`` of them sent at a time; and the number of blocks."""
    total, out = keys.count(), None
    blocks = -(-total // size)
    for k in range(blocks):
        block = keys.where(F.pmod(F.xxhash64(keys.columns[0]), F.lit(blocks)) == k) if blocks > 1 else keys
        block = np.sort(block.toArrow()[0].to_numpy().view(np.uint64))
        if len(block):
            send = rows.sparkSession.sparkContext.broadcast(block)
            part = checkpoint(rows.transform(mapped, run(send), schema))
            send.unpersist()
            out = part if out is None else out.unionByName(part)
    return out, blocks


def score_graph(pairs: DataFrame, rounds: int = ROUNDS, few: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) and (instance, belief) after the rounds.

    ``pairs`` has pattern, instance (null: an ordinary word), seed and n. A pattern's confidence is
    the mean belief of what fills its slots, seeds having belief 1; an instance's belief is
    1 - prod(1 - confidence) over its patterns. ``few`` patterns are broadcast.
    """
    small = F.broadcast if few else lambda df: df
    belief = pairs.where("instance is not null").groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(rounds):
        known = pairs.join(belief.withColumnRenamed("instance", "__i"), F.col("instance") == F.col("__i"), "left")
        confidence = known.groupBy("pattern").agg((F.sum(F.col("n") * F.coalesce("belief", F.lit(0.0))) / F.sum("n")).alias("confidence"))
        confidence = checkpoint(confidence)
        linked = pairs.where("instance is not null").join(small(confidence.withColumnRenamed("pattern", "__p")), F.col("pattern") == F.col("__p"))
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
        belief = checkpoint(linked.groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("belief")))
    return confidence, belief


def find_personal(docs: DataFrame, min_seeds: int = MIN_SEEDS, patterns: int = PATTERNS) -> DataFrame:
    """doc_id, base and spans (base and found ones) of each row; spans are (start, rank, end) in code
    points, by start and then kind.

    A null or empty text has none. Rows with equal id and text get equal spans. A null id is an
    id like any other. Found spans never overlap base spans of their row. An empty table gives an
    empty result. Every pattern of ``min_seeds`` seeds is scored, ``patterns`` of them in a pass. Very
    long texts are read whole, in time linear in their length but for the number of their slots.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__key"), F.col("text").alias("__text"))
    kind = "array<struct<start:long,rank:int,end:long>>"
    base = checkpoint(rows.transform(mapped, _seeds, f"doc_id long, __key long, base {kind}, seeds array<struct<pattern:long,instance:long>>"))
    seeds = base.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    induced = checkpoint(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("pattern"))
    none = base.select("doc_id", "base", F.col("base").alias("spans"))
    slots, blocks = _in_blocks(rows, induced, patterns, _slots, "pattern long, instance long, n long")
    if slots is None:
        return none
    known = seeds.select(F.col("instance").alias("__seed")).distinct()
    pairs = slots.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(known, F.col("instance") == F.col("__seed"), "left")
    pairs = checkpoint(pairs.select("pattern", "instance", "n", F.col("__seed").isNotNull().alias("seed")))
    confidence, belief = score_graph(pairs, few=blocks == 1)
    good = checkpoint(confidence.where(F.col("confidence") >= CONFIDENT).select("pattern", "confidence"))
    found, blocks = _in_blocks(rows, good.select("pattern"), patterns, _found, "pattern long, instance long, like long, first long, doc_id long, __key long, start long, end long")
    if found is None:
        return none
    small = F.broadcast if blocks == 1 else lambda df: df
    sure = belief.where(F.col("belief") >= BELIEVED).select("instance", F.lit(1).cast("long").alias("like"))
    # words of any form: by their patterns, and by how many of their occurrences are in these slots
    held = found.where("like = 0").groupBy("instance", "pattern").agg(F.sum("first").alias("n")).join(small(good), "pattern")
    doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
    held = checkpoint(held.groupBy("instance").agg((1 - doubt).alias("belief"), F.sum("n").alias("n")).where(F.col("belief") >= BELIEVED))
    every, _ = _in_blocks(rows, held.select("instance"), patterns, _occurrences, "instance long, n long")
    if every is not None:
        every = every.groupBy("instance").agg(F.sum("n").alias("all"))
        sure = sure.unionByName(held.join(every, "instance").where(F.col("belief") * F.col("n") / F.col("all") >= BELIEVED).select("instance", F.lit(0).cast("long").alias("like")))
    found = found.where("start is not null").join(sure, ["instance", "like"], "left_semi")
    span = F.struct(F.col("start"), F.lit(4).alias("rank"), F.col("end"))
    found = checkpoint(found.groupBy("doc_id", "__key").agg(F.collect_set(span).alias("more")).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"), "more"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__of")), "left")
    return joined.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def _written(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
