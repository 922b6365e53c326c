import math

import numpy as np

from docloom.llm import langid, queries
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def test_held_out(spark, sf):
    out = queries.op2_langid(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Être où l'été 12 " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.counts(text) == whole).all()


def test_frequencies_and_sparse_weights(spark):
    rows = [(i, "the cat and the dog went home" if i % 2 else "le chat et le chien sont là", "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df, n = langid.document_frequencies(docs)
    assert n == 60 and (df == sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows)).all()
    model = langid.train(docs)
    assert (model.weight != 0).mean() < 0.05
    assert model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr"
    assert model.predict("123 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    assert np.isfinite(model.temperature)


def test_odd_rows(spark):
    model = langid.train(odd_docs(spark))
    got = langid.predict(odd_docs(spark), model).collect()
    assert len(got) == odd_docs(spark).count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert langid.predict(no_docs(spark), langid.train(no_docs(spark))).count() == 0


def test_rare_languages_among_many_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_TRAIN", 60)
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(4000)]
    rows += [(5000 + 10 * k + j, chr(0x400 + 8 * k) * 9 + f" {chr(0x401 + 8 * k)} " * 3, f"l{k:02d}") for k in range(19) for j in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({x for *_, x in rows})


def test_long_texts_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_BYTES", 4000)
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * (500 if i % 4 < 2 else 1), "en" if i % 2 else "fr") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"] and model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr"


def plain_ftrl(data, langs, order):
    """The same regression over dictionaries, a number at a time."""
    z, n = [{} for _ in range(langs)], [{} for _ in range(langs)]

    def weight(k, j, l1):
        zz, nn = z[k].get(j, 0.0), n[k].get(j, 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((langid.BETA + math.sqrt(nn)) / langid.ALPHA + langid.L2)

    for r in order:
        x, y = data[r]
        w = [{j: weight(k, j, 0.0 if j == "bias" else langid.L1) for j in x} for k in range(langs)]
        s = [sum(w[k][j] * v for j, v in x.items()) for k in range(langs)]
        e = [math.exp(v - max(s)) for v in s]
        for k in range(langs):
            g0 = e[k] / sum(e) - (k == y)
            for j, v in x.items():
                g, old = g0 * v, n[k].get(j, 0.0)
                z[k][j] = z[k].get(j, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[k][j]
                n[k][j] = old + g * g
    return [{j: weight(k, j, 0.0 if j == "bias" else langid.L1) for j in z[k]} for k in range(langs)]


def test_regression_and_temperature_against_plain_versions():
    rng = np.random.default_rng(2)
    data = []
    for r in range(60):
        at = np.sort(rng.choice(40, 8, replace=False)).astype(np.int32)
        v = rng.random(8).astype(np.float32)
        data.append((at, v / np.sqrt((v * v).sum()), int(at.min() % 3)))
    order = [int(k) for _ in range(5) for k in rng.permutation(60)]
    weight, bias = langid.learn(data, 3, order)
    plain = plain_ftrl([({int(j): float(x) for j, x in zip(at, v)} | {"bias": 1.0}, y) for at, v, y in data], 3, order)
    for k in range(3):
        assert abs(bias[k] - plain[k]["bias"]) < 1e-5
        assert all(abs(weight[k, j] - plain[k].get(j, 0.0)) < 1e-5 for j in range(40)) and not weight[k, 40:].any()
    s, y = rng.normal(0, 4, (50, 3)), rng.integers(0, 3, 50)
    for t in (0.5, 1.0, 3.0):
        p = np.exp(s / t) / np.exp(s / t).sum(axis=1, keepdims=True)
        assert abs(langid.cross_entropy(s, y, t) + np.log(p[np.arange(50), y]).mean()) < 1e-9


def test_counts_and_values_by_hand():
    grams = {}
    text = "Ab  a1!"
    low = "ab a "
    seen = [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]
    for g in seen:
        grams[g] = grams.get(g, 0) + 1
    got = langid.counts(text)
    assert got.sum() == len(seen) and sorted(got[got > 0].tolist()) == sorted(grams.values())


def test_a_language_of_few_rows_is_learned_and_a_short_sample_works(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.temperature == 1.0 and model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr"
