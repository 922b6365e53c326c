"""The layout client against a fake service: cut answers, failures, repeats, pages without data."""

import pytest

from docloom.functions.ports import PortError
from docloom.sources import layout


class Fake:
    """Answers `most` pages a call; the first `down` calls fail, and every call with the page b'bad'."""

    def __init__(self, most=10, down=0):
        self.most, self.down, self.calls = most, down, []

    def __call__(self, pages):
        self.calls.append(len(pages))
        if len(self.calls) <= self.down or b"bad" in pages:
            raise PortError("down")
        return [p.decode() for p in pages[: self.most]]


def test_calls_are_counted():
    pages = [b"%d" % i for i in range(10)]
    f = Fake()
    assert layout.ask(f, pages, 3, 0) == [(str(i), None, 1) for i in range(10)] and f.calls == [10]
    f = Fake(most=3)
    assert [a for a, *_ in layout.ask(f, pages, 3, 0)] == [str(i) for i in range(10)] and f.calls == [10, 5, 2, 3, 5, 2, 3]
    f = Fake(down=2)
    assert [n for *_, n in layout.ask(f, pages, 3, 0)] == [3] * 10 and f.calls == [10, 10, 10]
    f = Fake(most=0)
    assert layout.ask(f, pages[:2], 3, 0) == [(None, "0 answers for one page", 2)] * 2


def test_one_bad_page_takes_no_other_with_it():
    got = layout.ask(Fake(), [b"a", b"bad", b"c", b"d", b"e"], 2, 0)
    assert [(a, e) for a, e, _ in got] == [("a", None), (None, "PortError: down"), ("c", None), ("d", None), ("e", None)]


def test_every_page_once(spark):
    rows = [(f"f{k}", i, b"bad" if i == 17 else None if i == 5 else b"%d.%d" % (k, i)) for k in range(3) for i in range(33)]
    rows += [("f0", 1, b"again"), (None, None, b"x"), ("long", 0, b"y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "path string, page int, data binary")
    for n in (1, 7):
        got = layout.analyse(pages.repartition(n), lambda: Fake(most=4), wait=0).collect()
        want = [(p, i, None if d in (None, b"bad") else d.decode(), {None: "no data", b"bad": "PortError: down"}.get(d)) for p, i, d in rows]
        assert sorted(map(repr, ((r.path, r.page, r.answer, r.error) for r in got))) == sorted(map(repr, want))
    assert layout.analyse(pages.limit(0), Fake).count() == 0


def test_other_mistakes_are_raised(spark):
    pages = spark.createDataFrame([("a", 1, b"x")], "path string, page int, data binary")
    with pytest.raises(Exception, match="division"):
        layout.analyse(pages, lambda: lambda p: 1 / 0).collect()
