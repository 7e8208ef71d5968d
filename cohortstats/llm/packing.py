"""Cost-balanced packing of whole documents into sequences of bounded length.

A document's cost is linear in its tokens plus quadratic attention. Within a group of
documents, full sequences are cut from long documents; the rest are assigned in
descending order to the cheapest sequence with room. A piece that fits nowhere is cut to
fill the emptiest sequence. What is left past the last full sequence, less than one, goes
on into the next group; at a task's end it forms sequences of powers of two, which need no
padding. Groups are packed where they are tokenized: no shuffle, memory bounded by a group,
and a lost task packs the same groups again.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, chunks, groups, mapped, mix, rolling, table, utf8

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Text packed together, about (one longer document is packed alone), and words a worker remembers.
GROUP_BYTES = 4 << 20
REMEMBERED = 500_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_BLANK, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_WORKER: dict = {}


def _classes() -> np.ndarray:
    """Of each character of the basic plane: what the tokenizer's own splitting makes of it.

    Letters, single digits and runs of ASCII signs are tokens of their own there. What this can't
    tell for sure (apostrophes, other white space, marks, all else past ASCII) leaves the part
    between two blanks whole, to be split by the tokenizer.
    """
    if "classes" not in _WORKER:
        out = np.full(1 << 16, _WHOLE, np.uint8)
        for c in range(1 << 16):
            if chr(c).isalpha():
                out[c] = _LETTER
        for c in range(33, 127):
            if out[c] != _LETTER and chr(c) != "'":
                out[c] = _DIGIT if chr(c).isdigit() else _SIGN
        out[[32, 10]] = _BLANK
        _WORKER["classes"] = out
    return _WORKER["classes"]


#: The splitting that ``_runs`` reproduces. A tokenizer that says anything else encodes whole texts itself.
_SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Words:
    """Ids of words, encoded once and kept in arrays sorted by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.splits = {k: said.get(k) for k in _SPLITTING} == _SPLITTING and said["model"].get("end_of_word_suffix") == "</w>"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, simple: list[str], whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the simple words and then of the whole parts, one after another; and how many each has."""
        got = np.array(self.tokenizer.encode_batch_fast(["\n".join(simple)], add_special_tokens=False)[0].ids, np.uint32) if simple else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[got]) if len(got) else np.zeros(0, np.int64)
        if len(last) == len(simple) and (not len(got) or last[-1] == len(got) - 1):
            sizes = np.diff(last, prepend=-1)
        else:
            whole, got, sizes = simple + whole, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        more = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)] if whole else []
        return np.concatenate((got, *[np.array(x, np.uint32) for x in more])), np.concatenate((sizes, [len(x) for x in more])).astype(np.int64)

    def look_up(self, hashes: np.ndarray, text, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each (ascending, distinct) word's ids begin, and how many there are."""
        if len(self.hashes) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != hashes[inside]
        fresh = np.flatnonzero(new)
        if len(fresh):
            order = np.concatenate((fresh[simple[fresh]], fresh[~simple[fresh]]))
            ids, sizes = self._encode([text(k) for k in fresh[simple[fresh]].tolist()], [text(k) for k in fresh[~simple[fresh]].tolist()])
            at = np.cumsum(sizes) - sizes + len(self.ids)
            back = np.argsort(order)
            self.ids = np.concatenate((self.ids, ids))
            where = place[fresh]
            self.hashes = np.insert(self.hashes, where, hashes[fresh])
            self.at = np.insert(self.at, where, at[back])
            self.sizes = np.insert(self.sizes, where, sizes[back])
            place = np.searchsorted(self.hashes, hashes)
        return self.at[place], self.sizes[place]


def _token_ids(column: pa.Array, path: str) -> list[np.ndarray]:
    """Each row's ids: those of its words, one after another."""
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, words=_Words(path))
    known = _WORKER["words"]
    if not known.splits:
        texts = [x or "" for x in column.to_pylist()]
        return [np.array(e.ids, np.uint32) for e in known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    offsets, data = utf8(column)
    out: list[np.ndarray] = []
    for a, b in chunks(offsets):
        raw = data[offsets[a] : offsets[b]]
        text = raw.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        begin = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets[a : b + 1] - offsets[a]]
        kind = _classes()[np.minimum(codes, 0xFFFF)]
        kind[codes > 0xFFFF] = _WHOLE
        kind[:-1][(codes[:-1] == 60) & (codes[1:] == 124)] = _WHOLE  # the start of a special token's string
        starts, ends, whole = _runs(kind, begin)
        low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
        hashes = mix(rolling(low + np.uint64(1), starts, ends, 0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) ^ (whole.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, sizes = known.look_up(unique, lambda k: text[starts[first[k]] : ends[first[k]]], ~whole[first])
        per = sizes[inverse]
        total = np.concatenate(([0], np.cumsum(per)))
        ids = known.ids[np.arange(total[-1]) + np.repeat(at[inverse] - total[:-1], per)]
        bounds = total[np.searchsorted(starts, begin)]
        out += [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _runs(kind: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and which of them are parts left whole."""
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    blank = kind == _BLANK
    # parts between blanks (and documents), and which hold a character that leaves them whole
    cut = edge[:-1] | blank
    cut[1:] |= blank[:-1]
    part = np.cumsum(cut) - 1
    left_whole = np.zeros(part[-1] + 1 if n else 0, bool)
    left_whole[part[kind == _WHOLE]] = True
    within = left_whole[part] if n else blank
    split = np.ones(n, bool)
    split[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = ~blank & (cut | (split & ~within))
    starts = np.flatnonzero(start)
    stop = np.ones(n, bool)
    stop[:-1] = start[1:] | blank[1:] | edge[1:-1]
    return starts, np.flatnonzero(stop & ~blank) + 1, within[starts]


def cost(tokens, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * tokens + quadratic * tokens * tokens


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these lengths.

    Sequences are full but for those of the tail, whose lengths are falling powers of two.
    """
    pieces, left, sequence = pack_full(lengths, capacity)
    tail = sum(n for _, _, n in left)
    return pieces + _assign(left, [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1], sequence)[0]


def pack_full(lengths: list[int], capacity: int = CAPACITY) -> tuple[list, list, int]:
    """Pieces in full sequences only; (document, start, length) of what is left, under one sequence; and the sequences."""
    pieces, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((d, full * capacity, n % capacity))
    whole = sum(n for _, _, n in rest) // capacity
    more, left = _assign(rest, [capacity] * whole, sequence)
    return pieces + more, left, sequence + whole


def _assign(parts: list[tuple[int, int, int]], sizes: list[int], sequence: int) -> tuple[list, list]:
    """Fills sequences of these sizes: each part, largest first, goes to the cheapest with room for it."""
    if not sizes:
        return [], parts
    rest = [(-n, d, start) for d, start, n in parts]
    heapq.heapify(rest)
    pieces = []
    room = np.array(sizes, np.int64)
    spent = np.zeros(len(sizes))
    used = np.zeros(len(sizes), np.int64)
    while rest:
        n, d, start = heapq.heappop(rest)
        n = -n
        fits = np.where(room >= n, spent, np.inf)
        to = int(np.argmin(fits))
        if fits[to] == np.inf:  # nowhere whole: fill the emptiest sequence and put the remainder back
            to = int(np.argmax(room))
            take = int(room[to])
            if not take:  # all are full
                rest.append((-n, d, start))
                break
            heapq.heappush(rest, (take - n, d, start + take))
            n = take
        pieces.append((d, start, n, sequence + to, int(used[to])))
        room[to] -= n
        used[to] += n
        spent[to] += cost(n)
    return pieces, [(d, start, -n) for n, d, start in rest]


def _pack_batches(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc_id, first token, all the document's tokens, ids from there on

        def found(docs: list[tuple], pieces: list) -> pa.RecordBatch:
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            ids, first, total = [docs[d][0] for d in doc], np.array([x[1] for x in docs])[doc], np.array([x[2] for x in docs])[doc]
            crc = [zlib.crc32(docs[d][3][s : s + n]) for d, s, n, _, _ in pieces]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total), pa.array(sequence + next_id), pa.array(offset)], schema=_PIECES)

        for part in groups(batches, 1, GROUP_BYTES):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in _token_ids(part.column(1), path)]
            docs = held + [(i, 0, len(x), x) for i, x in zip(part.column(0).to_pylist(), ids, strict=True)]
            pieces, left, made = pack_full([len(x[3]) for x in docs], capacity)
            if pieces:
                yield found(docs, pieces)
                next_id += made
            held = [(docs[d][0], docs[d][1] + s, docs[d][2], docs[d][3][s : s + n].copy()) for d, s, n in left]
        if held:
            yield found(held, pack([len(x[3]) for x in held], capacity))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id stays null in its pieces. Repeated
    rows are packed as often as they come. Sequence ids are unique within one result, not gapless, and
    follow from the partition that read a document. A text longer than a group is one by itself. An
    empty table gives no pieces. Only doc_id and text are read, whatever other columns are called.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.transform(mapped, _pack_batches(tokenizer_path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
