"""Workflows, staged writes, settings, objects and text helpers of ingest."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import ports
from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.operators import staging, tables, workflow
from docloom.plans import catalog
from docloom.sources import objects, settings


def test_workflow_order_and_failures(spark):
    seen = []

    def note(name):
        def f(df):
            seen.append(name)
            return df.select("no such column") if name == "embed" else df

        return f

    steps = {n: note(n) for n in workflow.DEFAULT}
    df, warnings = workflow.run(spark.range(3), "an unknown type", steps)
    assert seen == list(workflow.DEFAULT) and df.count() == 3 and len(warnings) == 1 and warnings[0].startswith("embed")
    steps["write"] = lambda df: df.select("no such column")
    with pytest.raises(RuntimeError, match="step write"):
        workflow.run(spark.range(3), "txt", steps)
    with pytest.raises(KeyError, match="parse"):
        workflow.chain(("parse",), {"chunk": None})
    workflow.step("own")(lambda df: df)
    assert workflow.chain(("own",))[0][0] == "own" and workflow.STEPS.pop("own")


def test_staged_write_goes_on_where_it_stopped(spark, tmp_path):
    items = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "c", False), (3, "d", None)], "doc_id long, chunk_id string, good boolean")
    none = spark.createDataFrame([], "doc_id long, meta boolean, fulltext boolean, vectors boolean, graph boolean")
    path = str(tmp_path / "stores")
    first = tables.store(staging.staged_write(items, {"fulltext": F.col("good")}, none, path))
    got = {r["doc_id"]: (r["status"], r["issues"]) for r in first.collect()}
    assert got == {1: ("done", []), 2: ("partial", ["fulltext_write_failed"]), 3: ("partial", ["fulltext_write_failed"])}
    again = staging.staged_write(items.withColumn("good", F.lit(True)), {"fulltext": F.col("good")}, first, path)
    assert {r["status"] for r in again.collect()} == {"done"}
    held = sorted((r["stage"], r["chunk_id"]) for r in staging.existing(spark, path).collect())
    assert held == sorted((s, c) for s in staging.STAGES for c in "abcd")
    bad = staging.staged_write(items, {"meta": F.lit(False)}, none, str(tmp_path / "other"))
    assert {r["status"] for r in bad.collect()} == {"failed"} and staging.existing(spark, str(tmp_path / "other")).count() == 0


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("llm:\n  url: ${URL:-http://x}\n  api_key: ${KEY}\nold: {a: 1}\nlist: [{Token: t}]\n")
    tree = settings.load(str(path), {"KEY": "k", "URL": ""}, {"old": "new"})
    assert tree == {"llm": {"url": "http://x", "api_key": "k"}, "new": {"a": 1}, "list": [{"Token": "t"}]}
    assert settings.redacted(tree)["llm"] == {"url": "http://x", "api_key": settings.HIDDEN} and settings.redacted(tree)["list"] == [{"Token": settings.HIDDEN}]
    w = settings.Watched(str(path), lambda p: open(p).read())
    before = w.get()
    path.write_text("other: 1\n")
    os.utime(path, ns=(1, 1))
    assert before.startswith("llm") and w.get() == "other: 1\n"
    os.remove(path)
    assert w.get() == "other: 1\n"


def test_evaluation_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q1", "relevant": ["1"], "keywords": ["k"]}, {"question": "q2"}, {"other": 1}]))
    assert [r["question"] for r in settings.evaluation_cases(spark, str(tmp_path)).orderBy("question").collect()] == ["q1", "q2"]


def test_objects(spark, tmp_path):
    store = objects.Store(spark, str(tmp_path / "o"))
    store.put("a/b.bin", b"\x00\x01")
    store.put("a/./c.txt", b"c")
    assert store.get("a/b.bin") == b"\x00\x01" and store.get("a/none") is None
    assert sorted((r["key"], r["length"]) for r in store.read().collect()) == [("a/b.bin", 2), ("a/c.txt", 1)]
    assert store.delete("a/b.bin") and not store.delete("a/b.bin")
    keys = ["/etc/x", "../x", "a/../../x", "", ".", "c:/x", "a\\..\\..\\x", "a/b", "..b/c", "a..b"]
    ok = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(objects.key_ok("k")).collect()]
    assert ok == [False] * 7 + [True] * 3
    for k, fine in zip(keys, ok):
        if fine:
            objects.safe_key(k)
        else:
            with pytest.raises(ValueError):
                objects.safe_key(k)


def test_json_and_budgets(spark):
    said = ['x {"a": {"b": 1}} y', "} {bad} {\"keywords\": [1]}", "no object", '{"a": 1} {"summary": "s"}', None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] for r in df.select(T.first_json("s")).collect()] == ['{"a": {"b": 1}}', '{"keywords": [1]}', "{}", '{"a": 1}', "{}"]
    assert [r[0] for r in df.select(T.first_json("s", ("summary", "keywords"))).collect()] == ["{}", '{"keywords": [1]}', "{}", '{"summary": "s"}', "{}"]
    assert T.budget_ladder(None) == [(512, 1500), (2048, 1500), (4096, 800)] and T.budget_ladder(100) == [(100, 1500)]
    assert T.budget_ladder(65536)[-1] == (65536, 800)


def test_ports(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        return lambda pairs: [float(len(q) + len(t)) for q, t in pairs]

    df = spark.createDataFrame([("ab", "c"), (None, "xyz")], "q string, t string").coalesce(1)
    assert [r[0] for r in df.select(ports.scorer(make)("q", "t")).collect()] == [3.0, 3.0] and made.value >= 1
    assert [r[0] for r in df.select(ports.generator(lambda: lambda xs: [x * 3 for x in xs], 4)("t")).collect()] == ["ccc", "xyzx"]
    assert df.select(ports.embedder(ports.word_buckets)("q")).first()[0][(97 + 98) % 8] == 1.0


def test_best_by_terms_is_exact(spark):
    import random

    rng = random.Random(3)
    hits = [(d, 0, f"t{w}", rng.random()) for d in range(400) for w in range(30) if rng.random() < 1 / (1 + w)]
    df = {w: sum(h[2] == f"t{w}" for h in hits) for w in range(30)}
    asked = [(q, 0, f"t{w}", 1.0 + w / 3, df[w]) for q in range(6) for w in rng.sample(range(30), 8) if df[w]]
    got = R.best_by_terms(
        tables.store(spark.createDataFrame(hits, "doc_id long, field int, term string, impact double")),
                spark.createDataFrame(asked, "qid long, field int, term string, weight double, df long"), 5
    )
    want = set()
    for q in range(6):
        weight = {t: w for a, _, t, w, _ in asked if a == q}
        score = {}
        for d, _, t, x in hits:
            if t in weight:
                score[d] = score.get(d, 0.0) + weight[t] * x
        want |= {(q, d, n) for n, (d, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 8), x[0]))[:5], 1)}
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in got.collect()} == want


def test_holders_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two three four five six sevenx"), (3, "two words"), (4, None)],
            "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "words"), (3, "two three four five six seven"), (4, None),
            (5, "three  four five six seven eight")], "qid long, item string")
    got = sorted((r["doc_id"], r["qid"]) for r in R.holders(docs, items).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 3), (3, 2)]


def test_workflows_come_from_a_file(spark, tmp_path):
    from docloom.operators import steps

    flows = workflow.load(steps.FILE)
    assert flows["txt"] == workflow.DEFAULT and set(workflow.DEFAULT) <= set(workflow.STEPS)
    path = tmp_path / "flows.json"
    path.write_text('{"default": ["parse", "chunk", "${LAST:-finalize}"]}')
    short = workflow.load(str(path))
    assert short == {"default": ("parse", "chunk", "finalize")}
    path.write_text('{"default": ["parse", "no such step"]}')
    with pytest.raises(KeyError, match="no such step"):
        workflow.load(str(path))
    docs = spark.createDataFrame([(1, "Same text here.\n\nsame TEXT here.\n\n" + "long " * 200, "txt", bytearray(b"Same"))], "doc_id long, text string, file_type string, head binary")
    done, warnings = workflow.run(docs, "txt", None, flows)
    row = done.first()
    assert not warnings and (row["n_chunks"], row["n_vectors"], row["n_flaws"], row["title"]) == (2, 1, 0, "Same text here.")
    broken = {**workflow.STEPS, "embed": lambda df: len(3)}
    with pytest.raises(TypeError):
        workflow.run(docs, "txt", broken, flows)


def test_variables_in_a_column(spark):
    lines = ["a ${X} b", "${X}${Y:-d}${Z}", "none", "${EMPTY:-x} $X ${", "", None, "${Y:-}${Y:-a:-b}"]
    env = {"X": "1 $0 \\\\1", "EMPTY": ""}
    m = F.create_map(*[F.lit(v) for pair in env.items() for v in pair])
    got = [r[0] for r in spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, x string").orderBy("n").select(settings.interpolated("x", m)).collect()]
    assert got == [x if x is None else settings.interpolate(x, env) for x in lines]


def test_table_functions(spark):
    from docloom.operators import tablefunctions

    tablefunctions.register(spark)
    docs = spark.createDataFrame([(1, "One sentence. Another one."), (2, None), (3, "")], "doc_id long, text string")
    got = spark.sql("select d.doc_id, c.* from {docs} d, lateral chunks(d.text, 'parents') c", docs=docs)
    assert got.columns == ["doc_id", "part", "text", "offset"] and [tuple(r) for r in got.where("doc_id = 1").collect()] == [(1, 0, "One sentence. Another one.", 0)]
    assert spark.sql("select c.* from {docs} d, lateral chunks(d.text, 'children', false) c", docs=docs).columns == ["part", "text"]
    html = spark.createDataFrame([(1, "<h1>T</h1><table><tr><th colspan=2>a</th></tr><tr><td>b</td><td>c</td></tr></table>")], "page_id long, html string")
    cells = spark.sql("select e.row, e.col, e.text from {html} p, lateral elements(p.html, 'table') e order by 1, 2", html=html).collect()
    assert [(r["row"], r["col"]) for r in cells] == [(0, 0), (0, 1), (1, 0), (1, 1)] and cells[3]["text"] == "c"
    assert spark.sql("select e.kind from {html} p, lateral elements(p.html, 'html') e", html=html).first()["kind"] == "TITLE"
    for bad in ("chunks(d.text, 'nothing')", "chunks(d.doc_id, 'parents')", "chunks(d.text, d.text)"):
        with pytest.raises(Exception, match="expected"):
            spark.sql(f"select c.* from {{docs}} d, lateral {bad} c", docs=docs).collect()


def test_rows_of_batches_come_a_few_at_a_time():
    taken = []

    class Batch:
        num_rows = 100

        def slice(self, at, n):
            taken.append(at)
            return pa.record_batch({"a": list(range(at, min(at + n, 100)))})

    rows = tables.rows_of([Batch()])
    assert [next(rows) for _ in range(3)] == [(0,), (1,), (2,)] and taken == [0]
    assert [r[0] for r in rows] == list(range(3, 100))
    assert [b.num_rows for b in tables.record_batches([("ab",)] * 7, pa.schema([("s", pa.string())]), 3)] == [3, 3, 1]
    assert [b.num_rows for b in tables.record_batches([("ab",)] * 7, pa.schema([("s", pa.string())]), 100, 4)] == [2, 2, 2, 1]


def test_supersede_looks_at_each_document_once(spark, tmp_path):
    """All documents are versions of one file; a frame that shrinks would be added up anew for each of them."""
    text = lambda i: None if i % 700 == 20 else f"v{i // 4000}"
    rows = [(40 * i + 4, text(i), "en", "s") for i in range(12_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["supersede"](spark, str(tmp_path))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString()
    later, want = set(), {}
    for doc_id, t, *_ in reversed(rows):
        want[doc_id] = t is not None and bool(later - {t})
        later |= {t} - {None}
    assert {r["doc_id"]: r["superseded"] for r in got.collect()} == want
