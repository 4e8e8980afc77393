"""CSV dumps in splits of any size against the csv module."""

import csv
import random

import pytest

from threadloom.sources import io, messages, quoted


def _dump(path, eol, seed, n=90):
    rng = random.Random(seed)
    pieces = ["a", "b ", ",", '"', "\n", "é", '""', ',"', '",', "\r\n" if eol == "\n" else "x"]
    rows = [[str(k), "a", "True", "x", "".join(rng.choice(pieces) for _ in range(rng.randrange(12))), "", "7"] for k in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(",".join(messages.RAW_COLUMNS) + eol)
        csv.writer(f, lineterminator=eol).writerows(rows)
    return {r[0]: None if r[4] in ("", *io.V.MISSING) else r[4] for r in rows}


@pytest.mark.parametrize(("eol", "size"), [("\n", 7), ("\n", 300), ("\n", 1 << 20), ("\r\n", 40)])
def test_splits(spark, tmp_path, eol, size):
    """Two files; records that go over several splits, quotes and line breaks at every bound."""
    (tmp_path / "dump").mkdir()
    want = {}
    for k in range(2):
        want |= {f"{k}-{i}": t for i, t in _dump(tmp_path / "dump" / f"{k}.csv", eol, 10 * size + k).items()}
    good, bad = io.read_messages(spark, f"{tmp_path}/dump", split_bytes=size)
    got = sorted((r.tweet_id, r.text or "") for r in good.collect())
    assert got == sorted((i.split("-")[1], t or "") for i, t in want.items()) and bad.count() == 0


def test_one_file_in_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/m.csv"
    _dump(path, "\n", 5, 400)
    size = io.size_in_bytes(spark, path)
    assert quoted.records(spark, path, size // 8).select("split").distinct().count() >= 8
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(size // 8)


def test_splits_of_bounded_size(spark, tmp_path, monkeypatch):
    """However large a split is asked for, none is beyond SPLIT, and those that begin inside a field pass row by row."""
    monkeypatch.setattr(quoted, "SPLIT", 500)
    want = _dump(f"{tmp_path}/m.csv", "\n", 8, 400)
    got = quoted.records(spark, f"{tmp_path}/m.csv", 1 << 30)
    assert got.select("split").distinct().count() >= io.size_in_bytes(spark, f"{tmp_path}/m.csv") // 1000
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {r.tweet_id: r.text for r in io.read_messages(spark, f"{tmp_path}/m.csv")[0].collect()} == want


def test_odd_records(spark, tmp_path):
    """Stray quotes are text; blank lines go; an open quote takes the rest of its file; a wrong header is refused."""
    head = ",".join(messages.RAW_COLUMNS)
    (tmp_path / "a.csv").write_text(f'{head}\n\n1,5" screen,True,x,he said "no",,\n2,a,True,x,"y" z,,\n \n3,a,True,x,"open\n4,a,True,x,t,,\n')
    for size in (9, 1 << 20):
        rows = {r.tweet_id: r for r in io.read_messages(spark, f"{tmp_path}/a.csv", split_bytes=size)[0].collect()}
        assert rows["1"].author_id == '5" screen' and rows["1"].text == 'he said "no"' and "2" in rows and "4" not in rows
        values = {r.value for r in quoted.records(spark, f"{tmp_path}/a.csv", size).collect()}
        assert values == {head, '1,5" screen,True,x,he said "no",,', '2,a,True,x,"y" z,,', '3,a,True,x,"open\n4,a,True,x,t,,\n'.rstrip("\n")}
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(io.MissingColumns):
        io.read_messages(spark, f"{tmp_path}/b.csv")
    (tmp_path / "c.csv").write_text(head + "\n")
    assert io.read_messages(spark, f"{tmp_path}/c.csv")[0].count() == 0


def test_ends_inside():
    """A line's two bits against a parser that reads it letter by letter."""
    rng = random.Random(6)

    def slow(line, inside):
        state = "quoted" if inside else "begin"
        for k, c in enumerate(line):
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif state == "quote":
                state = "quoted" if c == '"' else "begin" if c == "," else "plain"
            else:
                state = "begin" if c == "," else "quoted" if c == '"' and state == "begin" else "plain"
        return state == "quoted"

    for _ in range(4000):
        line = "".join(rng.choice('a,"" ') for _ in range(rng.randrange(14)))
        assert [quoted.ends_inside(line, b) for b in (False, True)] == [slow(line, b) for b in (False, True)], line


def test_beginnings(spark):
    rng = random.Random(7)
    ends = [[(rng.random() < 0.5, rng.random() < 0.5) if rng.random() < 0.5 else (False, True) for _ in range(30)] for _ in range(6)]
    rows = [(f, 10 * k, *e) for f, file in enumerate(ends) for k, e in enumerate(file)]
    got = {(r.file, r.split): r.begins for r in quoted.beginnings(spark.createDataFrame(rows, "file long, split long, outside boolean, inside boolean").repartition(3)).collect()}
    for f, file in enumerate(ends):
        state = False
        for k, e in enumerate(file):
            assert got[f, 10 * k] == state
            state = e[state]
