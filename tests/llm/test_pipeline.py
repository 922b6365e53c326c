import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import bpe, queries, toxicity
from docloom.llm.common import read

from .rows import odd_docs
from .test_decontam import plain as shingles
from .test_secrets import plain as base_spans
from .test_simhash import near_copy_groups


def test_whole_run_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    model = queries.toxicity_model(spark, sf)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    group = near_copy_groups([rows[i] for i in clean])
    least = {}
    for i in sorted(clean):
        least.setdefault(group[rows[i] or ""], i)
    kept = set(least.values())
    items = [shingles(r["text"]) for r in read(spark, sf, "benchmark").collect()]
    kept = {i for i in kept if not any(t and len(shingles(rows[i]) & t) >= 0.8 * len(t) - 1e-9 for t in items)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == kept
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in out.items():
        if not base_spans(rows[i]) and "secret" not in " ".join(lib.id_to_token(t) for t in r["ids"]):
            assert r["ids"] == lib.encode(rows[i], add_special_tokens=False).ids


def test_stages_keep_columns(spark, sf):
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == read(spark, sf, "documents").columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_rows_are_judged_by_their_texts(spark, sf):
    item = read(spark, sf, "benchmark").first()["text"]
    clean = [" ".join(f"word{k}x{n}" for n in range(60)) for k in range(4)]
    rows = [(None, f"before it {item} and after it"), (None, clean[0]), (7, f"other words first {item} then more"), (7, clean[1]), (8, clean[2]),
            (8, clean[2]), (None, clean[2]), (9, clean[3]), (9, f"{item} {clean[3]}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(rows)],
            "doc_id long, text string, lang string, source string, n_chars long, k0 int")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["benchmark decontamination"](spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted((str(r[0]), r[1]) for r in left.collect()) == sorted((str(i), t) for i, t in rows if item not in t)
    left = stages["simhash near-dedup"](spark, left, sf)
    assert sorted((str(r[0]), r[1]) for r in left.collect()) == sorted([("None", clean[0]), ("7", clean[1]), ("8", clean[2]), ("9", clean[3])])
    left = stages["secret scans"](spark, left.withColumn("text", F.concat("text", F.lit(" password=abcdefgh1"))), sf)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([(i, f"{t} [SECRET]") for i,
            t in (("None", clean[0]), ("7", clean[1]), ("8", clean[2]), ("9", clean[3]))])


def test_odd_rows(spark, sf):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd_docs(spark).columns and docs.count() > 0
    assert bpe.encode(docs, queries.TOKENIZER).count() == docs.count()
