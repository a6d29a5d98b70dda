import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, item = prose(70), prose(40)
    docs = [(i, prose(150), "en", "s", 0) for i in range(40)]
    docs += [(40, docs[3][1], "en", "s", 0), (41, docs[5][1].replace(docs[5][1].split()[9], "x"), "en", "s", 0), (42, "123 456 --", "en", "s", 0), (43, None, None, "s", 0)]
    docs += [(44, prose(60) + " " + passage, "en", "s", 0), (45, prose(80) + "\n" + passage, "en", "s", 0), (46, prose(60) + " " + item + " " + prose(30), "en", "s", 0)]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at.append({r.doc_id for r in now.collect()})
    everything = {d[0] for d in docs}
    assert at[0] == everything - {42, 43}
    assert at[1] == at[0] - {40, 41}
    assert at[2] == at[1] and at[3] == at[2] - {46} and at[4] == at[3]
    kept = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert kept[44].text == dict((d[0], d[1]) for d in docs)[44]
    assert len(kept[45].text.split()) < 110 and kept[45].n_chars == len(kept[45].text)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == at[4] and sum(r.length for r in final) > 0
