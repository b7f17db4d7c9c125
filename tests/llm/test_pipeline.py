"""The corpus pipeline on a small folder of tables."""

import random

import corpus_pipeline
from kbspark.llm.queries import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda: ". ".join("The " + " ".join(f"word{rng.randrange(3000)} of the" for _ in range(6)) for _ in range(8)) + "."
    texts = [prose() for _ in range(60)]
    texts += [texts[0], " ".join(texts[1].split()[:-1] + ["other."])] + [" ".join(w.upper() + "!!" for w in prose().split()) for _ in range(10)]
    toxic = {i for i in range(60) if i % 4 == 3}
    rows = [(i, t.replace("The ", "The scum ", 1) if i in toxic else t, "en", "s", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(60)) - toxic
    assert clean <= left["toxicity"] and len(left["toxicity"] & toxic) <= 3
    assert clean <= left["quality_classifier"] and not left["quality_classifier"] & set(range(62, 72))
    assert left["line_dedup"] == left["quality_classifier"] and left["best_fit_packing"] == left["minhash_near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_registry():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
