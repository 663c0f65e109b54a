import os

import pytest

from choralis.llm import queries as Q

COLUMNS = {
    "p1_found": {"id": "bigint"},
    "p2_found": {"field": "string", "id": "bigint"},
    "p3_found": {"track_id": "bigint", "field": "string", "id": "bigint"},
    "p4_found": {"id": "bigint", "lang": "string"},
    "p5_found": {"field": "string", "form_a": "string", "form_b": "string"},
    "p6_found": {"first_id": "bigint", "copy_id": "bigint"},
    "p7_found": {"field": "string", "id": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs_with_its_columns(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    rows = df.count()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name] and rows > 0
        assert name == "p8_ids" or df.distinct().count() == rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    for f in os.listdir(sf):
        d.execute(f"create view {f[:-8]} as from '{sf}/{f}'")
    df = Q.QUERIES[name](spark, sf)
    want = d.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_groups_have_all_fields(spark, tmp_path):
    """The groups of songs and albums as well: each pair of p5_found is in one group of its field."""
    rows = [(1, "Ballad of Nubrevu", "Christopher Dridrunu", "Voices of Rivara", 200.0), (2, "Balald of Nubrevu", "C. Dridrunu", "Voices of Rivara", 201.0), (3, "Ballad of Nubrevu", "Christopher Dridrunu", "Voices of Rivaar", 200.0)]
    spark.createDataFrame(rows, "id bigint, name string, artist_name string, album_name string, duration double").write.parquet(str(tmp_path / "tracks.parquet"))
    got = {}
    for r in Q.p5_groups(spark, str(tmp_path)).collect():
        got.setdefault((r["field"], r["group"]), set()).add(r["value"])
    assert sorted((f, *sorted(v)) for (f, _), v in got.items()) == [
        ("album_name", "Voices of Rivaar", "Voices of Rivara"),
        ("artist_name", "C. Dridrunu", "Christopher Dridrunu"),
        ("name", "Balald of Nubrevu", "Ballad of Nubrevu"),
    ]
