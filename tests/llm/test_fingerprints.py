import hashlib

import numpy as np

from docloom.llm import fingerprints as fp
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def check(df, rows):
    """rows: (doc_id, text), doc_ids distinct."""
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.to_text(fp.sketch(t)) and r["edited_fingerprint"] == fp.to_text(fp.sketch(edited))
        errors += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, nxt))]
    assert np.mean(errors) < 0.02 and max(errors) < 0.16


def test_tables(spark, sf):
    docs = read(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    check(fp.with_edits(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert fp.with_edits(docs).count() == docs.count()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(fp.with_edits(named), [tuple(r) for r in named.select("doc_id", "text").collect()])
    assert fp.with_edits(no_docs(spark)).count() == 0
    check(fp.with_edits(docs.where("doc_id = 7")), [(7, "one two three")])
    assert fp.sketches(docs).count() == docs.count()


def test_parts_merge_into_the_whole(spark):
    words = [f"w{k}" for k in range(5000)]
    parts = [" ".join(words[i : i + 504]) for i in range(0, 4500, 500)]
    df = spark.createDataFrame([("a", fp.to_text(fp.sketch(p))) for p in parts] + [("b", fp.to_text(fp.sketch(""))), (None, None)],
            "part string, fingerprint string")
    got = {r[0]: r[1] for r in fp.merge(df, "part").collect()}
    assert got["a"] == fp.to_text(fp.sketch(" ".join(words[:4504]))) and got["b"] == "" and got[None] == ""


def test_estimates():
    a, b = [f"a{k}" for k in range(4000)], [f"b{k}" for k in range(4000)]
    x, y = fp.sketch(" ".join(a)), fp.sketch(" ".join(a[:2000] + b[:2000]))
    assert abs(fp.resemblance(x, y) - 1 / 3) < 0.1
    assert abs(fp.containment(fp.sketch(" ".join(a[:2000])), x) - 1) < 0.2
    assert abs(fp.distinct(x) / 3996 - 1) < 0.2
