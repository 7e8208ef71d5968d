"""Long texts, hot groups, exact sizes, and workers that lack the package."""

import random
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortstats.llm import ann, common, dom, html_extract, importance, packing, secrets, simhash

from .test_operators import WORDS, brute_secrets, check_components, prose

REPO = Path(__file__).resolve().parents[2]


# ---- pages


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "<div>" * 4000 + "</x>" * 200_000, "<div>" * 10_000 + "x" + "</div>" * 10_000, '<a ">" ' * 100_000 + '"', "<!" * 300_000, "<a" * 300_000,
     "<div>" + "<i>" * 50_000 + "<li></li>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<a>" * 50_000 + "<b></b>" * 50_000],
    ids=["open", "stray", "deep", "quotes", "bang", "names", "inline", "crossed", "items", "links"],
)
def test_hostile_pages_take_linear_time(page):
    trees = html_extract.train()
    began = time.process_time()
    assert len(html_extract.main_text([page], trees)) == 1
    assert time.process_time() - began < 20


def test_depth_has_no_limit():
    page = dom.Page("<div>" * 6000 + "x")
    x, parent, _ = dom.features([page])
    assert x[:, 6].max() == 6000 and parent[-1] == 5999


def test_unknown_marks_are_ignored():
    assert dom.Page('<div data-y="foo"><p data-y=\'\'>a</p></div>').runs[0][1] == "a"


# ---- secrets


def test_fifty_thousand_matches_in_one_text(spark):
    r = random.Random(4)
    text = " ".join(f"é token={r.getrandbits(40):x}q {r.getrandbits(120):030x}" for _ in range(25_000))
    d = spark.createDataFrame([(1, text, "a/b"), (2, "x", "a/c")], "doc_id long, text string, source string")
    began = time.time()
    got = {x.doc_id: x for x in secrets.scan(d).select("doc_id", secrets._written("base").alias("b")).collect()}
    assert got[1].b == brute_secrets(text) and got[1].b.count(",") >= 49_000 and got[2].b == ""
    out = {x.doc_id: x.text for x in secrets.redact(d).collect()}
    assert out[2] == "x" and "token=" not in out[1] and out[1].count("[SECRET]") == 50_000 and out[1].replace("[SECRET]", "").split() == ["é"] * 25_000
    assert time.time() - began < 120


def test_redaction_of_overlapping_spans_across_blocks(spark):
    r = random.Random(9)
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(r.randint(1, 60)):
            parts.append(r.choice(["\U0001f600é" * r.randint(1, 700), "plain words ", f"password='{r.getrandbits(128):032x}' ", f"secret=AKIA{r.getrandbits(80):020X} ", " "]))
        texts.append("".join(parts))
    d = spark.createDataFrame([(i, t, f"o{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    live = {x.doc_id: [(s.start, s.end) for s in x.live] for x in secrets.scan(d).collect()}
    for x in secrets.redact(d).collect():
        want, at = [], 0
        for a, b in sorted(live[x.doc_id]):
            if a >= at:
                want += [texts[x.doc_id][at:a], "[SECRET]"]
            at = max(at, b)
        assert x.text == "".join(want) + texts[x.doc_id][at:] and x.n_chars == len(x.text)


def test_owners_and_repositories(spark):
    value = "Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9"
    other = value.replace("Z", "Q")
    rows = [(1, f"a {value}", "ann/x"), (2, f"b {value}", "ann/y"), (3, f"c {other}", "bob/x"), (4, f"d {other}", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    live = lambda **k: {x.doc_id for x in secrets.scan(d, **k).where(F.size("live") > 0).collect()}
    assert live() == {1, 2}  # two repositories of one owner; an owner and none are two
    assert live(max_repos=1) == set() and live(max_owners=2) == {1, 2, 3, 4}
    by = {(x.n_repos, x.n_owners, x.n_rows) for x in secrets.ownership(secrets.candidates(d)[1]).collect()}
    assert by == {(2, 1, 2), (2, 2, 2)}


# ---- importance resampling


@pytest.mark.parametrize("doc_id", [None, 7])
def test_the_draw_has_its_exact_size(spark, doc_id):
    good = spark.createDataFrame([(1,)], "doc_id long")
    d = spark.createDataFrame([(doc_id, "same text")] * 100, "doc_id long, text string").repartition(3)
    assert importance.resample(d, good, keep=0.8).count() == 80


def test_weights_against_brute_force(spark):
    r = random.Random(2)
    texts = [prose(r, r.randint(0, 120)) for _ in range(60)] + ["", None, "One", " ".join(prose(r, 40) for _ in range(10))]
    good = set(range(0, 60, 3))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    size = 1 << 12

    def grams(text):
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in (text or "").split()]
        h = [int(common.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0]) for x in w]
        pairs = [int(common.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x % size for x in h + pairs]

    assert all(c.isalnum() for w in WORDS for c in w)
    raw, target = np.zeros(size), np.zeros(size)
    for i, t in enumerate(texts):
        for b in grams(t):
            raw[b] += 1
            target[b] += i in good
    ratio = np.log((target + importance.PRIOR) / (raw * target.sum() / raw.sum() + importance.PRIOR))
    got = importance.resample(d, spark.createDataFrame([(i,) for i in good], "doc_id long"), keep=1.0, size=size).collect()
    assert len(got) == len(texts)
    for x in got:
        g = grams(texts[x.doc_id])
        want = sum(ratio[b] for b in g) * min(1, importance.LENGTH / max(len(g), 1))
        assert x.n_grams == len(g) and x.log_weight == pytest.approx(want, abs=1e-9)


# ---- packing


def test_a_tokenizer_of_another_splitting_encodes_itself():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    t = Tokenizer.from_file(path)
    texts = ["Mixed Case 123 don't  stop", None, "", "é \U0001f600\n\tx"]
    assert [x.tolist() for x in packing._token_ids(pa.array(texts), path)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_what_a_group_leaves_goes_on(monkeypatch, spark):
    r = random.Random(1)
    monkeypatch.setattr(packing, "GROUP_BYTES", 500)
    d = spark.createDataFrame([(i, prose(r, r.randint(1, 90))) for i in range(300)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(d, packing.default_tokenizer(), capacity=256).collect()
    sizes = {}
    for x in got:
        sizes[x.sequence_id] = sizes.get(x.sequence_id, 0) + x.length
    total = sum(x.doc_tokens for x in got if x.start == 0)
    assert sum(sizes.values()) == total and sum(v == 256 for v in sizes.values()) == total // 256


# ---- SimHash


def test_pairs_under_the_minimum_are_dropped_before_verification(monkeypatch):
    base = 0x0102030405060708
    fps = np.array([base, base ^ 1 << 3, base ^ 1 | 1 << 60, base ^ 0x010101, base ^ 0xFFFF], np.uint64)
    a, b = np.zeros(4, int), np.arange(1, 5)
    assert simhash.tally(fps[a], fps[b]).tolist() == [7, 6, 5, 6]
    seen = []
    monkeypatch.setattr(np, "bitwise_count", lambda x, f=np.bitwise_count: seen.append(len(x)) or f(x))
    got = simhash._retained(fps, a, b)
    assert seen == [3] and got[1].tolist() == [1, 2]


def test_every_close_pair_meets_in_a_list():
    r = random.Random(3)
    for i in range(64):
        for j in range(64):
            x = r.getrandbits(64)
            y = x ^ (1 << i | 1 << j)
            masks = [~sum(0xFF << 8 * p for p in free) & (2**64 - 1) for free in simhash._FREE[:6]]
            assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("long", [1, 40, 1 << 16])
def test_long_lists_are_dealt_out(spark, long):
    r = random.Random(12)
    base = r.getrandbits(64)
    fps = list(dict.fromkeys(base ^ (r.getrandbits(32) & r.getrandbits(32) & r.getrandbits(32) & r.getrandbits(32)) << 16 for _ in range(160)))
    fps += [r.getrandbits(64) for _ in range(20)]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = simhash._classes(spark.createDataFrame(rows, "doc_id long, fp long"), 3, long).collect()
    check_components([(x.fp & (2**64 - 1), x.doc_id, x.component_id) for x in got])


def test_of_rows_with_one_id_the_same_stays(spark):
    rows = [(1, prose(random.Random(k), 30), "en") for k in range(4)] + [(2, "a b c d", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [sorted(tuple(x) for x in simhash.near_dedup(d.repartition(n)).collect()) for n in (1, 3)]
    assert kept[0] == kept[1] and [x[0] for x in kept[0]] == [1, 2]


# ---- neighbours


def test_structured_vectors_need_few_candidates():
    r = np.random.RandomState(5)
    centres = r.randn(200, 64)
    x = (centres[np.arange(6000) % 200] + 0.25 * r.randn(6000, 64)).astype(np.float32).astype(float)
    queries = x[::100]
    index = ann._Tables(queries, 24, 2, 4, 7)
    q, row = index.candidates(x, len(queries))
    hits = 0
    for k, v in enumerate(queries):
        best = np.argsort(ann._distances(v[None], x), kind="stable")[1:11]
        hits += len(set(best.tolist()) & set(row[q == k].tolist()))
    assert len(q) <= 0.1 * len(queries) * len(x) and hits >= 0.95 * 10 * len(queries)


def test_components_beyond_the_range_of_squares(spark):
    rows = [(i, [1e200 * (i % 3 + 1), 1e-200, float(i), 2.0]) for i in range(13)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(ann.nearest_neighbours(d, "vec_id = 0").collect(), key=lambda x: x["rank"])
    assert [x.vec_id for x in got] == [3, 6, 9, 12, 1, 4, 7, 10, 2, 5] and got[0].score == 3.0 and got[4].score == pytest.approx(1e200)


def test_hot_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, -float(i)]) for i in range(50)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [x for x in ann.nearest_neighbours(d, "vec_id % 100 = 0").collect() if x.query_id == 300]
    assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"])] == list(range(10)) and all(x.score == 0 for x in got)


# ---- executors


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
    import sys
    sys.path.append({str(REPO)!r})
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    lacks = lambda _: [__import__("importlib.util").util.find_spec("cohortstats") is None]
    assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacks).collect() == [True]
    spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
    from cohortstats.llm import html_extract, langid
    d = spark.createDataFrame([(i, "the cat sat on the mat " * 3 if i % 2 else "el gato en la casa " * 3, "en" if i % 2 else "es") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.identify(d, ["doc_id"]).where("lang_pred = 'en'").count() == 30
    p = spark.createDataFrame([(1, "u", "<nav><a href=x>menu</a></nav><article><p>One long sentence of text, and another.</p></article>")], "page_id long, url string, html string")
    assert html_extract.extract(p).count() == 1
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
