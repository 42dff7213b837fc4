"""The pipeline's stages on a small corpus, each against what its operator says of its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(300)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(r.randint(10, 150)) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] = " ".join(x for w in texts[i].split() for x in ((w, "vileword") if r.random() < 0.15 else (w,))) + " vileword vileword"
    passage = prose(60)
    texts += [texts[1], texts[1] + " tail", f"{prose(40)} {passage} {prose(30)}", f"{prose(20)} {passage} {prose(50)}", None, "", "two words"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {i for i in range(0, 120, 6)}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").distinct().collect()}
    assert ids("toxicity") == set(range(127)) - toxic
    assert ids("near_duplicates") == ids("toxicity") - {120, 121}
    assert ids("substring_dedup") == ids("near_duplicates")
    cut = {r["doc_id"]: r for r in seen["substring_dedup"].collect()}
    assert 65 <= len(cut[123]["text"].split()) <= 75 and cut[123]["n_chars"] == len(cut[123]["text"]) and len(cut[122]["text"].split()) == 130
    taken = seen["mixing"].groupBy("doc_id").count()
    assert taken.agg(F.max("count")).first()[0] <= 3
    pieces = seen["packing"]
    assert ids("packing") == ids("mixing") and pieces.where(F.col("start") == 0).count() == seen["mixing"].count()


def test_run_on_an_empty_corpus(spark, sf_dir, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
