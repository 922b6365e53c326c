import itertools

import numpy as np

from docloom.llm import queries, toxicity
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def plain_marginals(theta, move):
    """Sums over all paths of one short document."""
    ot, to, tt = move
    step = {(0, 0): 0.0, (0, 1): ot, (1, 0): to, (1, 1): tt}
    n = len(theta)
    total, m, moves = 0.0, np.zeros(n), np.zeros(3)
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(step[a, b] + b * x for a, b, x in zip((0, *path), path, theta)))
        total += w
        m += w * np.array(path)
        for a, b in zip((0, *path), path):
            moves += w * np.array([(a, b) == (0, 1), (a, b) == (1, 0), (a, b) == (1, 1)])
    return m / total, moves / total


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 3, 0, 9, 7])
    docs = [rng.normal(0, 3, n) for n in lengths]
    move = (-1.0, 0.5, 1.3)
    m, moves = toxicity.marginals(np.concatenate(docs), lengths, move, expect=True)
    want = [plain_marginals(d, move) for d in docs if len(d)]
    assert np.allclose(m, np.concatenate([x for x, _ in want]))
    assert np.allclose(moves, sum(y for _, y in want))


def test_rows_of_a_long_document_agree():
    rng = np.random.default_rng(1)
    theta = rng.normal(-2, 2, 1000)
    move = np.array([-1.0, 0.2, 0.9])
    m, _ = toxicity.marginals(theta, np.array([1000]), move)
    a = np.array([1.0, 0.0])
    fs = []
    for x in theta:
        a = np.array([a[0] + a[1] * np.exp(move[1]), (a[0] * np.exp(move[0]) + a[1] * np.exp(move[2])) * np.exp(x)])
        a /= a.sum()
        fs.append(a)
    b, want = np.ones(2), np.zeros(1000)
    for t in range(999, -1, -1):
        want[t] = fs[t][1] * b[1] / (fs[t] * b).sum()
        e = np.exp(theta[t])
        b = np.array([b[0] + np.exp(move[0]) * e * b[1], np.exp(move[1]) * b[0] + np.exp(move[2]) * e * b[1]])
        b /= b.sum()
    assert np.allclose(m, want)


def test_held_out(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    out = queries.op1_toxicity(spark, d).join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert out["score"].between(0, 1).all()
    assert ((out["predicted"] == 1) == (out["score"] >= 0.7)).all()
    assert (out[out["toxic"] == 0]["predicted"] == 0).mean() > 0.98
    assert out[out["toxic"] == 1]["score"].median() > out[out["toxic"] == 0]["score"].quantile(0.99)


def test_spans_point_at_words(spark):
    rows = [("clean words of all sorts here " * 3, 0)] * 40 + [("you are an idiot and so on " * 2, 1)] * 40
    model = toxicity.train(rows)
    df = spark.createDataFrame([(1, "Été: an IDIOT spoke"), (2, "clean words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert any("IDIOT" in "Été: an IDIOT spoke"[s["start"] : s["end"]].split() for s in got[1]["spans"])
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[3]["spans"] == []


def test_odd_rows(spark):
    for model in (toxicity.train([]), toxicity.train([("a bad text", 1)]), toxicity.train([(None, 0), ("x", 1)])):
        assert toxicity.score(odd_docs(spark), model).count() == odd_docs(spark).count()
        assert toxicity.score(no_docs(spark), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert sorted(y for _, y in toxicity.labelled_sample(odd_docs(spark), labels)) == [0, 1, 1]


def test_texts_that_do_not_fit_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 2000)
    rows = [(i, f"text {i} " + "x" * (5000 if i % 4 < 2 else 10)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sorted(got) == sorted((t, i % 2) for i, t in rows if i % 4 >= 2)


def test_expected_counts_in_parts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([5, 70, 1, 200, 9])
    theta, move = rng.normal(-1, 2, 285), np.array([-1.0, 0.2, 0.9])
    monkeypatch.setattr(toxicity, "AT_ONCE", 60)
    for part, whole in zip(toxicity._marginals_in_parts(theta, lengths, move), toxicity.marginals(theta, lengths, move, expect=True)):
        assert np.allclose(part, whole)


def test_spans_where_lower_casing_changes_the_length(spark):
    rows = [("clean words of all sorts here " * 3, 0)] * 40 + [("you are an idiot and so on " * 2, 1)] * 40
    text = "x\u0130y said: an IDIOT spoke in \u0130zmir"
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxicity.train(rows)).first()
    assert got["predicted"] == 1 and any("IDIOT" in text[s["start"] : s["end"]].split() for s in got["spans"])
    assert [chr(c) for c in range(0x110000) if len(chr(c).lower()) > 1] == ["\u0130"]


def plain_likelihood(theta, move, gold):
    """Log-probability of one path among all."""
    ot, to, tt = move
    step = {(0, 0): 0.0, (0, 1): ot, (1, 0): to, (1, 1): tt}
    weigh = lambda path: sum(step[a, b] + b * x for a, b, x in zip((0, *path), path, theta))
    return weigh(gold) - np.log(sum(np.exp(weigh(path)) for path in itertools.product((0, 1), repeat=len(theta))))


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    lengths, gold = np.array([4, 6, 1]), np.array([0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1.0])
    theta, move, h = rng.normal(-1, 2, 11), np.array([-0.7, 0.4, 1.1]), 1e-5
    parts = [(0, 4), (4, 10), (10, 11)]
    total = lambda th, mv: sum(plain_likelihood(th[a:b], mv, gold[a:b].astype(int).tolist()) for a, b in parts)
    by_theta, by_move = toxicity.gradient(theta, lengths, move, gold)
    for got, x, f in ((by_theta, theta, lambda v: total(v, move)), (by_move, move, lambda v: total(theta, v))):
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += h
            down[i] -= h
            assert abs(got[i] - (f(up) - f(down)) / (2 * h)) < 1e-5


def test_neighbours_and_joined_spans():
    before, after = toxicity.neighbours(np.array([5, 6, 7, 8]), np.array([2, 0, 1, 1]), 9)
    assert before.tolist() == [9, 5, 9, 9] and after.tolist() == [6, 9, 9, 9]
    places = [(0, 2), (3, 5), (6, 8), (9, 11)]
    assert toxicity.joined(places, np.array([0.9, 0.6, 0.1, 0.8])) == [{"start": 0, "end": 5, "probability": 0.9}, {"start": 9, "end": 11, "probability": 0.8}]
    assert toxicity.features("1d1ot") == toxicity.features("idiot") and toxicity.features("2024") == ["=2024"] and toxicity.features("x") == ["=x"]


def test_unseen_forms_and_scores(spark):
    rng = np.random.default_rng(0)
    pool = [f"plain{k}" for k in range(200)]
    clean = lambda n: " ".join(rng.choice(pool, n))
    rows = [(clean(40), 0) for _ in range(200)] + [(f"{clean(15)} you scumb{'abcdefghijkl'[k % 12] * 3} {clean(15)}", 1) for k in range(60)]
    rows += [(f"{clean(15)} idiots {clean(15)}", 1) for _ in range(60)]
    model = toxicity.train(rows)
    assert model.before.get("you", 0) > 0
    texts = [f"{clean(10)} you scumbzzz {clean(5)}", f"{clean(10)} 1diots {clean(3)}", clean(300)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k]["predicted"] for k in range(3)] == [1, 1, 0]
    # the score is the logistic curve over the largest marginal and the expected number of toxic tokens
    words = toxicity.tokens_of(texts[0])
    theta = [model.potential(w) + (model.before.get(words[i - 1], 0.0) if i else 0.0) + (model.after.get(words[i + 1],
            0.0) if i + 1 < len(words) else 0.0) for i, w in enumerate(words)]
    m = plain_marginals(theta, model.move)[0]
    top = min(max(m.max(), 1e-9), 1 - 1e-9)
    z = model.curve[0] + model.curve[1] * np.clip(np.log(top / (1 - top)), -6, 6) + model.curve[2] * np.log1p(m.sum())
    assert abs(got[0]["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_gradient_asks_for_its_tokens_part_by_part(monkeypatch):
    """The driver never holds a potential for each token of the sample at once."""
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 30, 40)
    theta, gold, asked = rng.normal(size=lengths.sum()), (rng.random(lengths.sum()) < 0.3).astype(float), []
    by_part = toxicity.gradient(lambda part: asked.append(part) or theta[part], lengths, (0.1, -0.2, 0.3), gold)
    whole = toxicity.gradient(theta, lengths, (0.1, -0.2, 0.3), gold)
    assert len(asked) > 5 and max(p.stop - p.start for p in asked) <= 50
    assert all((a == b).all() for a, b in zip(by_part, whole))


def test_training_leaves_the_texts_to_a_task(spark, sf, monkeypatch):
    """The driver gets the model only, and it is the one that training on the collected sample gives."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    want = toxicity.train(toxicity.labelled_sample(docs, labels))
    monkeypatch.setattr(toxicity, "labelled_sample", None)
    got = toxicity.fit(docs, labels)
    assert got == want and got.weight
