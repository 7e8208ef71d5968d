"""The pipeline, stage by stage against brute force, on the smallest tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortstats.llm import decontaminate, langid, simhash

from .test_operators import brute_fingerprint, brute_hits

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r.text for r in out.collect()} if name != "packing" else None
        before = kept.get(k - 1)
        if name == "near_duplicates":
            fps = {i: brute_fingerprint(t) for i, t in before.items()}
            ids = sorted(fps)
            group = {i: i for i in ids}
            changed = True
            while changed:
                changed = False
                for a in ids:
                    for b in ids:
                        if group[a] < group[b] and (fps[a] ^ fps[b]).bit_count() <= 2:
                            group[b], changed = group[a], True
            assert set(rows) == {i for i in ids if group[i] == i}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            some = sorted(before)[:60]
            assert {i for i in some if i in rows} == {i for i in some if not brute_hits(before[i], items, 10)[1]}
        elif name == "secret_scan":
            assert set(rows) == set(before) and all(rows[i] == t or "[SECRET]" in rows[i] for i, t in before.items())
        elif name == "packing":
            first = [r.doc_id for r in out.where("start = 0").collect()]
            assert sorted(first) == sorted(before)
        kept[k], docs = rows, out
    assert len(kept[0]) >= 195


def test_run_equals_the_stages(spark):
    from cohortstats.llm import common

    docs = common.table(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == want


def test_language_limits_come_from_all_rows(spark):
    r = random.Random(14)
    make = {"aa": "ka lo mi pa re su", "bb": "ka lu mo po ri se"}
    rows = [(i, " ".join(r.choice(make[k].split()) for _ in range(r.randint(1, 4))), k) for i, k in enumerate(["aa", "bb"] * 6400)]
    rows += [(20_000 + i, " ".join(r.choice("qx zw vy jh".split()) for _ in range(i % 7 + 1)), "bb") for i in range(9)]
    rows += [(30_000 + i, "ka " * (i % 9) + "".join(r.choice("kalomipresu qxzwvyjh") for _ in range(i % 17 + 3)), None) for i in range(300)]
    d = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    model = langid.train(d)
    every = d.select("text", "doc_id", "lang", langid.held_out(F.col("doc_id")).alias("held"))
    scored = every.transform(langid.mapped, langid._score(model), "doc_id long, lang string, held boolean, n long, letters long, bits array<double>").where("letters > 0").collect()
    train = [x for x in scored if x.lang and not x.held]
    assert len(train) > 9000
    bits, n, true = np.array([x.bits for x in train]), np.array([x.n for x in train]), np.array([model.langs.index(x.lang) for x in train])
    at = np.arange(len(train))
    steep = min(2.0 ** np.arange(-4, 5, 0.5), key=lambda s: -np.log(np.maximum(langid._posterior(bits, n, s)[at, true], 1e-6)).mean())
    p = langid._posterior(bits, n, steep)
    good = p.argmax(1) == true
    least = min(np.quantile(p[good].max(1), langid.REJECT, method="lower"), 0.5) * 0.9
    most = np.quantile(bits[good].min(1), 1 - langid.REJECT, method="higher") * 1.5
    bits, n = np.array([x.bits for x in scored]), np.array([x.n for x in scored])
    passed = (langid._posterior(bits, n, steep).max(1) >= least) & (bits.min(1) <= most)
    want = {x.doc_id for x, ok in zip(scored, passed.tolist(), strict=True) if ok}
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, d, DIR).collect()} == want != {x.doc_id for x in scored}


def test_odd_rows_through_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the house of the word", "en", "s", 5), (3, "the house of the word", "en", "s", 5), (3, "the house of the word", "en", "s", 5), (4, "x " * 20_000, None, "s", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() >= 1
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.near_dedup(docs).collect()) == ["1", "3", "4", "None"]
    assert decontaminate.decontaminate(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).count() == 6
