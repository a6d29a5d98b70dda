import random

import numpy as np
import pytest

from notemill.llm.langid import LEAST_SAMPLE, STRETCH, LanguageModel, has_letter, held_out, identify, in_known_language, language_samples, normalise


def plain_phrases(text, sample):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample and text[at : at + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("lanes,few", [(1, 48), (3, 0), (8192, 0), (8192, 2), (8192, 48)])
def test_phrases_equal_direct_search(monkeypatch, lanes, few):
    monkeypatch.setattr("notemill.llm.langid.LANES", lanes)
    monkeypatch.setattr("notemill.llm.langid.FEW", few)
    rng = random.Random(1)
    sample = bytes(rng.choice(b"abc ") for _ in range(200))
    texts = [bytes(rng.choice(b"abcd ?") for _ in range(rng.choice([0, 5, STRETCH, 2 * STRETCH, rng.randint(0, 3000)]))) for _ in range(30)]
    texts += [sample * 20, (sample * 20)[3:], sample[:37] * 90, b"a" * 5000, b"?" * 1500, (b"ab " * 700 + b"?c") * 4]  # phrases longer than a part, and none
    known = LanguageModel({"x": sample})
    got = known.costs(texts)[:, 0] * np.maximum(1, [len(t) for t in texts]) / known.weight[0]
    assert got.round(6).tolist() == [plain_phrases(t, sample) for t in texts]


def test_samples_are_whole_texts(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"<{name(i)} " * 20 + ">", "de") for i in range(200)] + [(i, "lang " * 400, "de") for i in range(200, 210)] + [(300, "seul texte " * 5000, "fr"), (301, "x " * 9000, "pt"), (302, "y " * 700, "pt")]
    found = language_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=4000)
    assert found["fr"] == normalise("seul texte " * 5000)[:4000] and found["pt"] == normalise("y " * 700)
    words = found["de"].split()
    assert len(words) % 20 == 0 and all(len(set(words[i : i + 20])) == 1 for i in range(0, len(words), 20)) and 3000 < len(found["de"]) <= 4000


WORDS = {"en": "the of and thing that with here other", "de": "der und nicht ein schön über auch zwischen", "fr": "le les été où français être avec nous"}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(40)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(300, 2) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "der und " * 60_000, None), (1004, "THE OF AND THAT", "en"), (None, "les été", "fr")]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    samples = language_samples(df.where(~held_out()))
    assert sorted(samples) == sorted(WORDS) and all(len(s) <= 32_768 for s in samples.values())
    got = identify(df, samples).withColumn("out", held_out()).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.out and r.lang and r.lang_pred != "und"]
    assert tested and all(r.lang_pred == r.lang for r in tested)
    pred = {r.doc_id: r for r in got}
    assert [pred[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "de", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in identify(df.limit(2), {}).collect()] == ["und", "und"]
    assert identify(df.limit(0), samples).collect() == [] and language_samples(df.limit(0)) == {}


def test_texts_in_other_languages_go(spark):
    rng = random.Random(4)
    parts = {"en": "th er on an re he in ed nd ha at en es of or".split(), "de": "ein sch ver er ung keit lich heit zu ä über der".split()}
    invented = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, invented(lang, rng.randint(1, 80)), lang) for i in range(400) for lang in [("en", "de")[i % 2]]]
    other = [
        "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli jota puhutaan", "Wikipedia jest wielojęzyczną encyklopedią internetową redagowaną przez ochotników",
        "Ласкаво просимо до нашого міста, де кожен може знайти щось цікаве", "中国的首都是北京，人口很多。", "qwx zzkp vbnj wqpk xxjv kkqz bvbv pqpq wjwj " * 200, None, "12 !",
    ]
    keep = [(1000, "in", "en"), (1001, "ver", None), (1002, invented("de", 20_000), "de"), (1003, invented("en", 60) + " password=39886b6a3ae06c044d", "en"), (None, invented("en", 30), None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_samples(labelled)
    assert all(len(x) >= LEAST_SAMPLE for x in samples.values())
    docs = spark.createDataFrame([*rows, *keep, *[(2000 + k, t, None) for k, t in enumerate(other)]], labelled.schema)
    kept = in_known_language(docs, samples)
    assert sorted(kept.collect(), key=str) == sorted(docs.where("doc_id IS NULL OR doc_id < 2000").collect(), key=str)
    # Of too small a sample nothing but texts without letters is rejected.
    assert in_known_language(docs, {"en": samples["en"][:500]}).count() == docs.count() - 2
    assert in_known_language(docs, {}).count() == in_known_language(docs.limit(0), samples).count() == 0


def test_letters():
    assert has_letter("1 é") and not has_letter("½ 1_ 😀")
    assert normalise("ÉA1b") == "éa b".encode()
