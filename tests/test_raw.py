"""Statements as text: arguments, next states, what isn't taken."""

import hashlib

import pytest

from ledgerloom.operators import raw
from ledgerloom.sources import container, export, seed
from tests.test_import import exported


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statements(spark):
    t = {"a": spark.createDataFrame([(1, "x", None), (2, "y?", 5)], "id long, name string, n long")}
    assert rows(raw.query(t, "SELECT id FROM a WHERE name = 'y?' AND n = ?", [5])) == [(2,)]
    assert rows(raw.run(t, "update a set name = concat(name, ',', ?), n = (id + 1) * 2 where n is null", ["z"])["a"]) == [(1, "x,z", 4), (2, "y?", 5)]
    assert rows(raw.run(t, "DELETE FROM a WHERE n > 1;")["a"]) == [(1, "x", None)] and rows(raw.run(t, "DELETE FROM a")["a"]) == []
    assert rows(raw.run(t, "INSERT INTO a (name, id) VALUES ('w', ?)", [9])["a"])[-1] == (9, "w", None)
    assert rows(raw.run(t, "INSERT OR IGNORE INTO a (id, n) SELECT id + 1, 7 FROM a")["a"]) == [(1, "x", None), (2, "y?", 5), (3, None, 7)]
    assert rows(t["a"]) == [(1, "x", None), (2, "y?", 5)]
    for bad, arguments in (("DROP TABLE a", None), ("SELECT 1", None), ("DELETE FROM a WHERE id = ?", []), ("UPDATE a SET nothing = 1", None)):
        with pytest.raises(ValueError):
            raw.run(t, bad, arguments)


def test_report(spark):
    data, _, _ = exported(seed.sample(spark))
    inner = container.deflated(data)
    hashes, lines = export.report(spark, b"file", inner, data)
    assert hashes == {k: hashlib.sha256(v).hexdigest() for k, v in (("file", b"file"), ("plain", inner), ("payload", data))}
    found = {r["line_sha256"] for r in lines.collect()}
    assert found == {hashlib.sha256(x).hexdigest() for x in data.split(b"\n")[1:-2]} and lines.count() == 8
