import gzip
import sqlite3

import pytest

from choralis.sources.sqlite_source import SQLiteGz, list_tables


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16le", "UTF-16be"])
def test_reads_all_types(spark, tmp_path, encoding):
    path = tmp_path / "a.sqlite"
    db = sqlite3.connect(path)
    db.execute(f"PRAGMA encoding = '{encoding}'")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INT, r REAL, s TEXT, b BLOB)")
    ints = [0, 1, -1, 127, -129, 1 << 20, 1 << 30, 1 << 40, -(1 << 62), None]
    rows = [(i + 1, n, i / 4, "é日" * (i * 3000), bytes(range(256)) * i) for i, n in enumerate(ints)]
    db.executemany("INSERT INTO t VALUES (?,?,?,?,?)", rows)
    db.commit()
    db.close()
    gz = tmp_path / "a.sqlite.gz"
    gz.write_bytes(gzip.compress(path.read_bytes()))
    spark.dataSource.register(SQLiteGz)
    for p in (path, gz):
        df = spark.read.format("sqlite_gz").option("path", str(p)).option("table", "t").option("scratch", str(tmp_path)).option("partitions", "3").load()
        assert df.dtypes == [("id", "bigint"), ("n", "bigint"), ("r", "double"), ("s", "string"), ("b", "binary")]
        assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect()) == rows


def test_empty_and_wrong(spark, tmp_path):
    path = tmp_path / "e.sqlite"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)")
    db.commit()
    db.close()
    spark.dataSource.register(SQLiteGz)
    assert spark.read.format("sqlite_gz").option("path", str(path)).option("table", "t").load().count() == 0
    bad = tmp_path / "x"
    bad.write_bytes(b"not a database at all")
    with pytest.raises(Exception, match="SQLite"):
        spark.read.format("sqlite_gz").option("path", str(bad)).option("table", "t").load().collect()


def test_lists_tables(tmp_path):
    path = tmp_path / "t.sqlite"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE tracks (id INTEGER PRIMARY KEY AUTOINCREMENT)")
    db.execute("CREATE TABLE lyrics (id INTEGER)")
    db.execute("CREATE INDEX i ON lyrics (id)")
    db.commit()
    db.close()
    assert list_tables(str(path)) == ["tracks", "lyrics"]
