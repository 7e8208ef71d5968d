"""Language identification by interpolated Kneser-Ney character models.

Four-gram counts of every labelled training document are summed in Spark, by language.
All types give the lower orders' continuation counts and discounts, in Spark too. The
model is built and sent in blocks by the two symbols in the middle of a four-gram, which
its contexts and lower orders share: a block holds all that scores its four-grams. The
orders of a block lie in arrays sorted by hash, with one column of log probabilities a
language, so one binary search a character scores all languages. A document gets the language of the lowest cross-entropy a character; what
that is worth, and which documents are rejected, is calibrated on all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, checkpoint, chunks, mapped, mix, table, utf8
from .importance import kth_largest

#: Bytes of a block of the model, about. All types are in some block; a task holds one block at a time.
BLOCK_BYTES = 64 << 20
#: Symbols that a task scores by one block before it turns to the next.
SYMBOLS = 2 << 20
#: Share of the training documents told right that may be rejected.
REJECT = 0.0005
#: How steep a score can be.
STEEPS = 2.0 ** np.arange(-4, 5, 0.5)

_SPACE, _OTHER = 32, 0xFFFF
_TABLE: dict = {}


def _symbols() -> np.ndarray:
    """For each character of the basic plane: its lower case if it is a letter, else a space."""
    if "t" not in _TABLE:
        out = np.full(1 << 16, _SPACE, np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _TABLE["t"] = out
    return _TABLE["t"]


def _text_symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single blanks of each document, where each begins, and how many letters it has."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begin = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
    out = _symbols()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    for c in np.unique(codes[far]):
        out[far[codes[far] == c]] = _OTHER if chr(c).isalpha() else _SPACE
    blank = out == _SPACE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    first = begin[:-1][begin[:-1] < begin[1:]]
    keep[first] = ~blank[first]  # what stands before a document counts as blank
    letters = np.concatenate(([0], np.cumsum(~blank)))[begin]
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[begin], np.diff(letters)


def _grams(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each symbol with the three before it in its document, blanks before its start, 16 bits each."""
    n = len(symbols)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    key = symbols.astype(np.uint64)
    for k in range(1, 4):
        before = np.full(n, _SPACE, np.uint64)
        before[k:] = symbols[: n - k] if n >= k else before[k:]
        before[place < k] = _SPACE
        key |= before << np.uint64(16 * k)
    return key


def _chunk_grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    offsets, data = utf8(column)
    for a, b in chunks(offsets, 1 << 18):
        symbols, at, letters = _text_symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, _grams(symbols, at), at, letters


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-gram counts of a task by language, summed before they are sent."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def sent(lang: str) -> pa.RecordBatch:
        keys, n = summed(held.pop(lang))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, grams, at, _ in _chunk_grams(batch.column(0)):
            row = np.repeat(np.arange(a, b), np.diff(at))
            names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
            for k, lang in enumerate(names.tolist()):
                keys, n = np.unique(grams[which[row - a] == k], return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > 200_000:
                    held[lang] = [summed(held[lang])]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > 100_000:
                        yield sent(lang)
    for lang in list(held):
        yield sent(lang)


def _lower(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The types of order k below those of the next order, and how many different characters stand before each."""
    types, n = np.unique(grams & np.uint64((1 << 16 * k) - 1), return_counts=True)
    return types, n.astype(float)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))


class Model:
    """Log2 probabilities of all languages for the types that any of them has, order by order.

    A block of a model has the whole model's lower orders and discounts given.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], lower_orders: dict | None = None, discounts: dict | None = None, chars: int | None = None):
        self.langs = sorted(counts)
        low = lambda k: np.uint64((1 << 16 * k) - 1)
        per = {}
        for lang, (grams, n) in counts.items():
            orders = {4: (grams, n.astype(float)), 3: _lower(grams, 3)}
            for k in (2, 1):
                orders[k] = lower_orders[lang][k] if lower_orders else _lower(orders[k + 1][0], k)
            per[lang] = orders
        self.chars = chars or (max(2, len(np.unique(np.concatenate([o[1][0] for o in per.values()]))) + 1) if per else 2)
        self.floor = -np.log2(self.chars)
        self.hashes, self.logs, self.context, self.weights = {}, {}, {}, {}
        lower: dict = {}
        for k in (1, 2, 3, 4):
            types = np.unique(np.concatenate([per[lang][k][0] for lang in self.langs]))
            contexts = np.unique(types >> np.uint64(16))
            p, w = np.zeros((len(types), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            of = np.searchsorted(contexts, types >> np.uint64(16))
            if k > 1:
                below = lower["p"][np.searchsorted(lower["types"], types & low(k - 1))]
            else:
                below = np.full((len(types), len(self.langs)), 1 / self.chars)
            for j, lang in enumerate(self.langs):
                mine, n = per[lang][k]
                d = discounts[lang, k] if discounts else _discount((n == 1).sum(), (n == 2).sum())
                at = np.searchsorted(types, mine)
                total = np.bincount(of[at], n, len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                seen = total > 0
                w[seen, j] = d * kinds[seen] / total[seen]
                got = np.zeros(len(types))
                got[at] = np.maximum(n - d, 0) / total[of[at]]
                p[:, j] = got + w[of, j] * below[:, j]
            lower = {"types": types, "p": p}
            for keys, values, into, to in ((types, p, self.hashes, self.logs), (contexts, w, self.context, self.weights)):
                h = mix(keys.copy())
                order = np.argsort(h)
                into[k], to[k] = h[order], np.log2(values[order]).astype(np.float32)

    @classmethod
    def of(cls, parts: dict) -> Model:
        """The model of these attributes: plain arrays are what is sent, so executors need no copy of the package."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    @staticmethod
    def _place(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.copy())
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return at, hashes[at] == h

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of each four-gram's last symbol, a column a language."""
        at, known = self._place(self.hashes[4], grams)
        out = self.logs[4][at]
        todo = np.flatnonzero(~known)
        out[todo] = 0
        for k in (4, 3, 2):
            if not len(todo):
                return out
            part = grams[todo] & np.uint64((1 << 16 * k) - 1) if k < 4 else grams[todo]
            at, known = self._place(self.context[k], part >> np.uint64(16))
            out[todo[known]] += self.weights[k][at[known]]
            at, known = self._place(self.hashes[k - 1], part & np.uint64((1 << 16 * (k - 1)) - 1))
            out[todo[known]] += self.logs[k - 1][at[known]]
            todo = todo[~known]
        out[todo] += self.weights[1][0] + self.floor
        return out


def _middle(grams: np.ndarray) -> np.ndarray:
    """The symbol before the last and the one before that: what deals four-grams to blocks."""
    return (grams >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(16) | grams >> np.uint64(32) & np.uint64(0xFFFF)


class Blocks:
    """A model in broadcast blocks; block k has the four-grams whose middle is firsts[k] or more, and under the next."""

    def __init__(self, langs: list[str], firsts: list[int], sends: list):
        self.langs, self.firsts, self.sends = langs, np.array(firsts, np.uint64), sends

    def sums(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of grams[at[i]:at[i + 1]] for each i, the summed log probabilities, a column a language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        block = np.searchsorted(self.firsts, _middle(grams), "right") - 1 if len(self.sends) > 1 else None
        for k, send in enumerate(self.sends):
            mine = None if block is None else np.flatnonzero(block == k)
            if mine is not None and not len(mine):
                continue
            model = Model.of(send.value)
            held, bounds = (grams, at) if mine is None else (grams[mine], np.searchsorted(mine, at))
            for x in range(0, len(held), 1 << 16):
                logs = model.score(held[x : x + (1 << 16)])
                edge = np.clip(bounds - x, 0, len(logs))
                rows = np.flatnonzero(edge[1:] > edge[:-1])
                if len(rows):
                    out[rows] += np.add.reduceat(logs, edge[rows], axis=0, dtype=np.float64)
            if mine is not None:
                del model, send._value  # read again for the next symbols, so that one block is held
        return out


def _score(blocks: Blocks):
    """n (symbols scored), letters, and each language's cross-entropy in bits a symbol."""
    width = len(blocks.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams, at, letters in _held(batches):
            n = np.diff(at)
            entropy = -blocks.sums(grams, at) / np.maximum(n, 1)[:, None]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(entropy.ravel()), width).cast(pa.list_(pa.float64())) if width else pa.array([[]] * len(n), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n), pa.array(letters), flat], names=[*part.schema.names[1:], "__n", "__letters", "__bits"])

    def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Chunks; where there are several blocks, the chunks of a batch by some millions of symbols."""
        most = SYMBOLS if len(blocks.sends) > 1 else 0
        for batch in batches:
            held, size, first = [], 0, 0
            for a, b, grams, at, letters in _chunk_grams(batch.column(0)):
                held.append((grams, at, letters))
                size += len(grams)
                if size >= most or b == batch.num_rows:
                    ends = np.cumsum([0, *(len(g) for g, _, _ in held)])
                    at = np.concatenate([x[:-1] + e for (_, x, _), e in zip(held, ends, strict=False)] + [ends[-1:]])
                    yield batch.slice(first, b - first), np.concatenate([g for g, _, _ in held]), at, np.concatenate([x for _, _, x in held])
                    held, size, first = [], 0, b

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _symbol(k: int) -> Column:
    """The k-th symbol from the end of a type."""
    return F.shiftrightunsigned("gram", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _firsts(counted: DataFrame, most: int) -> list[int]:
    """Where blocks of at most ``most`` rows begin, in order of the four-grams' middles; one middle is never parted."""
    cells = [(r.c << 16, r.n) for r in counted.groupBy(_symbol(1).alias("c")).agg(F.count("*").alias("n")).collect()]
    heavy = [c >> 16 for c, n in cells if n > most]
    if heavy:
        split = counted.where(_symbol(1).isin(heavy)).groupBy(_symbol(1).alias("c"), _symbol(2).alias("b")).agg(F.count("*").alias("n")).collect()
        cells = [(c, n) for c, n in cells if n <= most] + [(r.c << 16 | r.b, r.n) for r in split]
    firsts, held = [0], 0
    for c, n in sorted(cells):
        if held and held + n > most:
            firsts.append(c)
            held = 0
        held += n
    return firsts


def _by_lang(rows: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Types in order and their counts, by language."""
    found = rows.toArrow()
    names, grams, n = found["lang"].to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    out = {}
    for lang in langs:
        mine = np.flatnonzero(names == lang)
        mine = mine[np.argsort(grams[mine])]
        out[lang] = grams[mine], n[mine].astype(float)
    return out


def train(docs: DataFrame) -> Blocks | None:
    """Counts over every training document (text and lang not null, not held out), of all types."""
    sc = docs.sparkSession.sparkContext
    rows = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    orders = {4: checkpoint(rows.transform(mapped, _counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))}
    discounts = {}
    for k in (4, 3, 2, 1):
        if k < 4:
            below = orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
            orders[k] = checkpoint(below)
        for r in orders[k].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts[r.lang, k] = _discount(r.ones, r.twos)
    langs = sorted({lang for lang, _ in discounts})
    if not langs:
        return None
    single = _by_lang(orders[1], langs)
    chars = max(2, len(np.unique(np.concatenate([types for types, _ in single.values()]))) + 1)
    firsts = _firsts(orders[4], max(1, BLOCK_BYTES // (8 + 4 * len(langs))))
    sends = []
    for first, end in zip(firsts, [*firsts[1:], 1 << 32], strict=True):
        fours, twos = orders[4], orders[2]
        if len(firsts) > 1:
            middle = F.shiftleft(_symbol(1), 16).bitwiseOR(_symbol(2))
            fours = fours.where((middle >= F.lit(first)) & (middle < F.lit(end)))
            twos = twos.where(_symbol(1).between(first >> 16, (end - 1) >> 16))
        pairs = _by_lang(twos, langs)
        sends.append(sc.broadcast(vars(Model(_by_lang(fours, langs), {lang: {2: pairs[lang], 1: single[lang]} for lang in langs}, discounts, chars))))
    return Blocks(langs, firsts, sends)


def _evidence(batch: pa.RecordBatch, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored rows: each language's bits, the symbols scored, and which language is true."""
    bits = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    true = pa.compute.index_in(batch.column(0), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    return bits, batch.column(1).to_numpy(zero_copy_only=False), true


def _losses(langs: list[str]):
    """Log losses by steepness, summed as whole numbers, so that no order of the rows changes a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n, true = _evidence(batch, langs)
            sums = []
            for steep in STEEPS:
                p = _posterior(bits, n, steep)
                loss = -np.log(np.maximum(p[np.arange(len(p)), true], 1e-6))
                sums.append(int(np.round(loss * 2.0**40).astype(np.int64).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STEEPS), dtype=np.int32)), pa.array(sums, pa.int64()), pa.array([len(n)] * len(STEEPS), pa.int64())], names=["k", "loss", "n"])

    return run


def _told(langs: list[str], steep: float):
    """Of rows whose language is told right, its score and bits, as longs that sort alike (neither is negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n, true = _evidence(batch, langs)
            p = _posterior(bits, n, steep)
            good = p.argmax(1) == true
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (p[good].max(1), bits[good].min(1))], names=["score", "bits"])

    return run


def _calibrate(docs: DataFrame, model: Blocks) -> tuple[float, float, float]:
    """How steep the score is in the gap of cross-entropies, the least score and the most bits that are accepted.

    Every training document with a letter counts. Both limits are exact order statistics.
    """
    langs = model.langs
    if len(langs) < 2:
        return 1.0, 0.0, float("inf")
    labelled = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    scored = checkpoint(labelled.transform(mapped, _score(model), "lang string, __n long, __letters long, __bits array<double>").where("__letters > 0"))
    losses = scored.transform(mapped, _losses(langs), "k int, loss long, n long").groupBy("k").agg(F.sum(F.col("loss").cast("decimal(20,0)")).alias("loss"), F.sum("n").alias("n")).collect()
    if not losses or losses[0].n < 20:
        return 1.0, 0.0, float("inf")
    steep = float(STEEPS[min(losses, key=lambda r: (r.loss, r.k)).k])
    told = checkpoint(scored.transform(mapped, _told(langs, steep), "score long, bits long"))
    good = told.count()
    if not good:
        return steep, 0.0, float("inf")
    rank = int(REJECT * (good - 1)) + 1
    least, most = (float(np.int64(kth_largest(told, k, name)).view(np.float64)) for name, k in (("score", good + 1 - rank), ("bits", rank)))
    return steep, min(least, 0.5) * 0.9, most * 1.5


def _posterior(bits: np.ndarray, n: np.ndarray, steep: float) -> np.ndarray:
    x = -steep * np.sqrt(n)[:, None] * (bits - bits.min(1, keepdims=True))
    e = np.exp2(np.maximum(x, -1000))
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``docs`` and lang_pred, score (0 to 1), rejected and bits.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not 2, and
    uses nothing but the text to predict. Null text or text without a letter: ``und``, score 0,
    rejected. Without any training row every row is ``und``. Ties go to the language that sorts
    first. Null ids are training rows like any other.
    """
    found = _identified(docs, names)
    return found.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score", "__rejected": "rejected", "__least": "bits"})


def _identified(docs: DataFrame, names: list[str]) -> DataFrame:
    """The same under names that no column of documents has."""
    model = train(docs)
    picked = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    if model is None:
        return picked.select(*[F.col(f"`{c}`") for c in names], F.lit("und").alias("__lang_pred"), F.lit(0.0).alias("__score"), F.lit(True).alias("__rejected"), F.lit(None).cast("double").alias("__least"))
    steep, least, most = _calibrate(docs, model)
    scored = picked.transform(mapped, _score(model), f"{kinds}, __n long, __letters long, __bits array<double>")
    low = F.array_min("__bits")
    odds = F.aggregate("__bits", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), -steep * F.sqrt("__n") * (x - low)))
    pred = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position("__bits", low).cast("int"))
    none = F.col("__letters") == 0
    score = F.when(none, 0.0).otherwise(1 / odds)
    return scored.select(
        *[F.col(f"`{c}`") for c in names], F.when(none, "und").otherwise(pred).alias("__lang_pred"), score.alias("__score"),
        (none | (score < least) | (low > most)).alias("__rejected"), F.when(~none, low).alias("__least"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language, all columns unchanged."""
    return _identified(docs, docs.columns).where(~F.col("__rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_langid": op1_langid}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
