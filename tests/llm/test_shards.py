import zlib
from collections import Counter, defaultdict

from docloom.llm import shards
from docloom.llm.common import read

from .rows import no_docs, odd_docs


def check(df, docs, n):
    out, rows = df.collect(), docs.select("doc_id", "text").collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    at = defaultdict(list)
    for r in out:
        at[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in at.values())
    assert all(0 <= k < n for k in at)
    where = defaultdict(set)
    for r in out:
        where[r["virtual_slot"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    return out


def test_near_equal_bytes(spark, sf):
    docs = read(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    total = Counter()
    for r in check(shards.shard(docs, 40), docs, 40):
        total[r["shard"]] += r["size"]
    assert len(total) == 40
    mean = sum(total.values()) / 40
    assert max(total.values()) < 1.1 * mean and min(total.values()) > 0.9 * mean


def test_odd_rows(spark):
    check(shards.shard(odd_docs(spark), 4), odd_docs(spark), 4)
    assert shards.shard(no_docs(spark), 4).count() == 0


def test_equal_rows_keep_the_law(spark, monkeypatch):
    """A third of the rows are one row: bytes stay near equal, whatever the runs."""
    monkeypatch.setattr(shards, "RUN", 700)
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, '', repeat('x', cast(id % 50 as int))) as text")
    total = Counter()
    for r in check(shards.shard(docs, 8), docs, 8):
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 8
    assert len(total) == 8 and all(abs(v - mean) < 0.1 * mean for v in total.values())


def test_growing_moves_slots_only_into_the_new_shard():
    loads = {k: (k * 7919) % 1000 + 1 for k in range(512)}
    before = shards.assign(loads, 8, 512)
    after = shards.grow(before, loads, 8)
    assert all(a == b or b == 8 for a, b in zip(before, after))
    total = Counter()
    for k, s in enumerate(after):
        total[s] += loads[k]
    mean = sum(loads.values()) / 9
    assert all(abs(v - mean) < 0.15 * mean for v in total.values())


def test_map_versions(spark, tmp_path):
    shards.save_map(spark, str(tmp_path), 1, [0, 1, 0, 1])
    shards.save_map(spark, str(tmp_path), 2, [0, 1, 2, 1])
    assert [r["shard"] for r in shards.load_map(spark, str(tmp_path), 2).orderBy("virtual_slot").collect()] == [0, 1, 2, 1]
    assert [r["shard"] for r in shards.load_map(spark, str(tmp_path), 1).orderBy("virtual_slot").collect()] == [0, 1, 0, 1]


def test_rebalancing_stores_the_next_version(spark, sf, tmp_path):
    docs, path = read(spark, sf.replace("sf0.001", "sf0.01"), "documents"), str(tmp_path / "map")
    before = {r["doc_id"]: r for r in check(shards.shard(docs, 8, map_path=path), docs, 8)}
    after = {r["doc_id"]: r for r in check(shards.rebalance(docs, path), docs, 9)}
    assert {r["map_version"] for r in before.values()} == {1} and {r["map_version"] for r in after.values()} == {2}
    assert all(a["virtual_slot"] == before[k]["virtual_slot"] and a["shard"] in (before[k]["shard"], 8) for k, a in after.items())
    total = Counter()
    for r in after.values():
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 9
    assert len(total) == 9 and all(abs(v - mean) < 0.2 * mean for v in total.values())
    assert {r["map_version"] for r in shards.rebalance(docs, path, 8, version=1).collect()} == {3} and shards.latest_version(spark, path) == 3
    assert {r["map_version"] for r in shards.shard(docs, 8, map_path=path).collect()} == {4}
