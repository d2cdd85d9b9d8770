"""The stages, each against what its operator says about its own input."""

import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_neardup import brute

import corpus_pipeline
from tidewatch.llm import decontaminate, ranking
from tidewatch.session import staged

NAMES = ["quality_classifier", "near_dedup", "decontamination", "mix", "token_files"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with junk, copies and passages of a benchmark, and with clashing extra columns."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choices("bcdfglmnprst", k=rng.randrange(2, 7))) for _ in range(n)]
    items = [(k, " ".join(text(20))) for k in range(5)]
    docs, labels = [], []
    for i in range(240):
        words = text(rng.randrange(30, 120))
        junk = i % 7 == 3
        if junk:
            words = [w.upper() + "!!" for w in words]
        elif i > 11 and i % 11 == 4:
            words = [w if rng.random() > 0.005 else "zz" for w in docs[i - 11][1].split()]
        elif i % 13 == 5:
            words[7:7] = items[i % 5][1].split()
        docs.append((i, " ".join(words), "en", f"s{min(i % 4, 2)}", 1, i, "n"))
        labels.append((i, int(not junk), 0))
    docs.append((500, None, None, None, None, None, None))
    docs.append((501, " ".join(text(40_000)), "en", "s1", 1, 501, "n"))
    docs = [(*d, "r", 7, "p", 1.5) for d in docs]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, size long, node string, "
              "removed string, again int, pattern string, times double")
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    known = dict(labels.select("doc_id", "quality").collect())

    good = staged(stage["quality_classifier"](spark, docs, folder))
    scored = ranking.quality_scores(docs, labels).where("predicted = 1")
    assert {i for i, _ in texts(good)} == {r["doc_id"] for r in scored.collect()}
    judged = {i for i, _ in texts(good)} - {500, 501}
    assert sum(known[i] for i in judged) > 0.95 * len(judged) and len(judged) > 0.95 * sum(known.values())

    single = staged(stage["near_dedup"](spark, good, folder))
    groups = brute(texts(good), 5)
    assert sorted(i for i, _ in texts(single)) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert single.count() < good.count()

    clean = staged(stage["decontamination"](spark, single, folder))
    bad = {i for i, t in texts(single) if t and any(k in t for _, k in texts(items.withColumnRenamed("item_id", "doc_id")))}
    assert bad and {i for i, _ in texts(single)} - {i for i, _ in texts(clean)} == bad
    assert decontaminate.leaks(clean, items).isEmpty()

    mixed = staged(stage["mix"](spark, clean, folder))
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= {i for i, _ in texts(clean)} and max(times.values()) <= 3
    words = F.size(F.split("text", " "))
    whole = clean.agg(F.sum(words)).first()[0]
    # documents are taken whole, so a target is missed by half of the longest one at most
    assert mixed.agg(F.sum(words)).first()[0] == pytest.approx(whole, abs=0.05 * whole + 40_000 / 2)
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns

    out = stage["token_files"](spark, mixed, folder).orderBy("start").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    start = 0
    for row, (i, text) in zip(out, sorted(texts(mixed))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(out) == mixed.count()


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_does_not_hide_missing_modules():
    assert "except" not in open(sys.modules["corpus_pipeline"].__file__).read()
