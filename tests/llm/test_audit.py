import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from docloom.llm import audit, queries
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def plain(docs, labels):
    """Every order walked document by document."""
    least, out, failing = {}, {}, []
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and least[t] < i
        marks = [(q, x) for j, q, x in labels if j == i and i is not None]
        failing.append((part or "", {c for c, v in f.items() if v}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    for part in {p for p, *_ in failing}:
        own, total = [r for r in failing if r[0] == part], dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, c in enumerate(order, 1):
                here = [r for r in left if c in r[1]]
                rows[part, order, step] = [len(left) - len(here), len(here), sum(c in r[1] for r in gone), sum(r[1] == {c} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
                total[c] += len(here)
                left, gone = [r for r in left if c not in r[1]], gone + here
        out |= {k: (*v, total[k[1][k[2] - 1]]) for k, v in rows.items()}
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in read(spark, sf, "documents").collect()]
    labels = [tuple(r) for r in read(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    assert as_dict(queries.op13_audit(spark, sf)) == plain(docs, labels)


def test_sql_twin(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(audit.SQL)
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in names]
    got = queries.op13_audit(spark, sf)
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_odd_rows(spark):
    kind = "doc_id long, quality int, toxic int, text string"
    marks = [(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1), (10, 1, 0), (10, 1, 0)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], kind)
    docs = odd_docs(spark).withColumn("source", F.when(F.col("doc_id") < 4, "s").when(F.col("doc_id") == 4, ""))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert as_dict(audit.audit(docs, labels)) == plain(rows, marks)
    assert as_dict(audit.audit(docs, labels.where("false"))) == plain(rows, [])
    assert audit.audit(no_docs(spark), labels).count() == 0


def test_every_edge_of_the_conditions(spark):
    w = " ".join(f"w{k}" for k in range(50))
    texts = [w, w.rsplit(" ", 1)[0], " ".join(f"w{k % 65}" for k in range(100)), " ".join(f"w{k % 64}" for k in range(100)), "A" + "b" * 19, "A" + "b" * 18, "x|y", "a\x0bb\x85c\xa0d" * 30, w]
    docs = [(9 - k, t, "p") for k, t in enumerate(texts)]
    got = audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert as_dict(got) == plain(docs, [])


def test_sums_invert_exactly(spark):
    counts = spark.range(32).select(F.lit("p").alias("part"), F.col("id").cast("int").alias("mask"), (F.col("id") * 7919 % 1000).alias("n_all"),
            F.lit(0).alias("n_good"), F.col("id").alias("n_toxic"))
    cells = audit.parity_sums(counts).select("label", "sums", audit.invert(F.col("sums")).alias("cells")).collect()
    got = {r["label"]: r for r in cells}
    assert got["all"]["cells"] == [k * 7919 % 1000 for k in range(32)] and got["toxic"]["cells"] == list(range(32))
    assert got["all"]["sums"][0] == sum(k * 7919 % 1000 for k in range(32)) and got["good"]["sums"] == [0] * 32
