import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, queries
from docloom.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string, _parts string, example int"


def plain(rows):
    """(conv_id, turn, role, text) -> conv_id: turns, replies."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(got, rows):
    want = plain(rows)
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_whole_table(spark, sf):
    got = queries.op11_chat(spark, sf).collect()
    check(got, rows_of(read(spark, sf, "conversations")) + [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(chat.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    got = queries.op11_chat(spark, sf)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want


def test_examples_hold_their_prefix_and_mask_one_reply(spark):
    rows = [(1, 0, "system", "be # brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "a ### b"), (1, 3, "user", "more"), (1, 4, "assistant", "</turn>")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    head = "### system:\nbe # brief\n</turn>\n### user:\nhi\n</turn>\n### assistant:\n"
    assert [r["example"] for r in got] == [3, 5] and [r["whole"] for r in got] == [False, True]
    assert got[0]["text"] == head + "a \\### b\n</turn>\n"
    assert got[1]["text"] == got[0]["text"] + "### user:\nmore\n</turn>\n### assistant:\n\\</turn>\n</turn>\n"
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in got] == ["a \\### b", "\\</turn>"]


def test_conversations_that_do_not_end_with_a_reply(spark):
    rows = [(1, 0, "user", "only"), (2, 0, "assistant", "a"), (2, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.examples(df).collect()
    assert sorted((r["conv_id"], r["example"], r["loss_end"] is None) for r in got) == [(1, 1, True), (2, 1, False), (2, 2, True)]
    check(chat.read_back(chat.examples(df)).collect(), rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "null turn"), (1, 0, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (1, 2, "assistant", "x" * 200_000),
        (None, 1, "user", "u"), (None, 2, "assistant", "😀 é"), (3, 0, "role\nwith\\n lines: ### </turn>", "\n</turn>\n"), (3, 1, "assistant", "\\"),
        (3, 2, "assistant", "\\\n</turn>\n### assistant:\n####\\"), (3, 3, "assistant", "\n"), (4, 0, "user", "\\n"),
    ]
    df = spark.createDataFrame([(*r, "p", 9) for r in rows], SCHEMA)
    check(chat.read_back(chat.examples(df)).collect(), rows)
    assert chat.read_back(chat.examples(df.where("false"))).count() == 0


def test_control_strings_come_back(spark):
    rng = random.Random(5)
    bits = ["\\", "#", "##", "###", "</turn>", "</tur", "n>", "\n", "n", ":", "### user:\n", "a", " ", "\\n", "é"]
    made = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant", made()]), made()) for k in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(chat.read_back(chat.examples(df)).collect(), rows)
    marked = df.select(chat.escape(F.col("text")).alias("e")).where("e rlike '(?<!\\\\\\\\)###' or e rlike '(?<!\\\\\\\\)</turn>'")
    assert marked.count() == 0


@pytest.mark.parametrize("turns", [300])
def test_long_conversation(spark, turns):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "w" * 50) for k in range(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.examples(df).count() == turns // 2
    check(chat.read_back(chat.examples(df)).collect(), rows)
