import re

import duckdb

from docloom.llm import decontam, queries
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def plain(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def check(docs, items):
    d = [(r[0], plain(r[1])) for r in docs.select("doc_id", "text").collect()]
    i = [(r[0], plain(r[1])) for r in items.select("item_id", "text").collect()]
    want = {(a, b) for a, s in d for b, t in i if t and len(s & t) >= 0.8 * len(t) - 1e-9}
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return want


def test_tables(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    assert check(read(spark, d, "documents"), read(spark, d, "benchmark"))


def test_part_of_an_item_is_enough(spark):
    words = [f"w{k}" for k in range(44)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:7])), (3, "just three words"), (4, None), (4, ""), (1, " ".join(words))],
            "item_id long, text string")
    noise = [f"n{k}" for k in range(3000)]
    docs = spark.createDataFrame(
        [(k, " ".join(noise[: 7 * k] + words[:k] + noise[7 * k :])) for k in range(30, 45)] + [(99, "Just, three WORDS!"),
                (98, "x y just three words z"), (97, None)], "doc_id long, text string"
    )
    want = check(docs, items)
    assert (36, 1) in want and (35, 1) not in want and (99, 3) in want and (98, 3) not in want


def test_shuffled_items_agree(spark, sf, monkeypatch):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 50)
    check(docs, items)


def test_long_items_that_share_shingles(spark):
    words = [f"w{k}" for k in range(5000)]
    items = spark.createDataFrame([(k, " ".join(words[:2000] + [f"x{k}"] + words[2000 + k :])) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(words[: 1000 * k])) for k in range(6)] + [(7, "all items begin alike " * 3)], "doc_id long, text string")
    assert check(docs, items)


def test_partitions_and_sketches(spark):
    sizes = (3, 5, 6, 9, 40, 60, 200)
    items = spark.createDataFrame([(n, " ".join(f"i{n} w{k}" for k in range(n))) for n in sizes], "item_id long, text string")
    sketches = decontam.item_sketches(items)
    rows = sketches.collect()
    longest = {c: max(r["n"] for r in rows if r["size_class"] == c) for c in {r["size_class"] for r in rows}}
    assert all(len(r["sketch"]) == min(r["n"], decontam.sketch_size(longest[r["size_class"]])) for r in rows)
    assert all(2 ** r["size_class"] <= r["n"] < 2 ** (r["size_class"] + 1) for r in rows)
    parts = decontam.partitions(sketches)
    assert [top for _, _, top in parts] == [max(max(r["sketch"]) for r in rows if r["size_class"] == c) for c in sorted(longest)]
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, " ".join(f"d{k}" for k in range(3000)))], "doc_id long, text string")
    for r in decontam.document_sketches(docs, parts, ("doc_id",)).collect():
        top = max(t for _, least, t in parts if len(r["_s"]) >= least)
        assert sorted(r["_h"]) == sorted(h for h in r["_s"] if h <= top)


def test_one_partition_for_all_sizes_is_worse(spark, sf):
    """Ceilings differ between partitions; without them items keep more, documents are sketched more and more candidates meet."""
    d = sf.replace("sf0.001", "sf0.01")
    words = read(spark, d, "documents").orderBy("doc_id").limit(60).collect()
    short = [(1000 + k, " ".join((r["text"] or "").split()[:12])) for k, r in enumerate(words) if len((r["text"] or "").split()) > 200]
    items = read(spark, d, "benchmark").unionByName(spark.createDataFrame(short, "item_id long, text string"))
    docs = read(spark, d, "documents")
    parted, whole = (decontam.partition_figures(docs, items, partitioned=p) for p in (True, False))
    print(parted, whole)
    assert len(set(parted["ceilings"].values())) == len(parted["ceilings"]) > 2
    assert all(whole[k] > parted[k] for k in ("postings", "sketched", "candidates"))


def test_sql(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(decontam.SQL).fetchall()
    got = [tuple(r) for r in queries.op3_decontamination(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs"), (2, "word word word word word word")],
            "item_id long, text string")
    assert {(1, 1), (None, 1), (9, 2)} <= check(odd_docs(spark), items)
    assert decontam.contaminated(no_docs(spark), items).count() == 0
    assert decontam.contaminated(odd_docs(spark), items.where("false")).count() == 0


def test_sketch_sizes():
    assert [decontam.sketch_size(n) for n in (1, 4, 5, 10, 50)] == [1, 1, 2, 3, 11]
