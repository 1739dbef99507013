import pytest
from lodestone.operators.keyed_table import KeyedTable
from lodestone.streaming.upserts import upsert_stream

SCHEMA = "id string, v int, note string"


def held(table):
    return {r["id"]: (r["v"], r["note"]) for r in table.rows().collect()}


def test_upserts_replace_by_key(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "id")
    with pytest.raises(ValueError, match="no table"):
        t.rows()
    t.create()
    t.create()
    assert t.rows().count() == 0
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert t.upsert(make(("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 9, "z")))
    assert held(t) == {"a": (2, None), "b": (1, "y")}
    assert t.upsert(make(("b", None, None), ("c", 3, "w")))
    assert held(t) == {"a": (2, None), "b": (None, None), "c": (3, "w")}
    t.compact()
    before = held(t)
    assert t.upsert(make(("c", 4, "w"))) and held(t) == before | {"c": (4, "w")}
    t.drop()
    assert not t.exists()
    t.create()
    assert t.rows().count() == 0


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "id")
    t.create()
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert t.upsert(make(("a", 1, "x")), 5) and not t.upsert(make(("a", 7, "other")), 5)
    assert held(t) == {"a": (1, "x")}
    # a batch whose rows were written, in part or whole, before the log could name it: not seen, and written anew
    make(("zombie", 1, "x")).write.parquet(f"{t.path}/rows/batch=6")
    assert held(t) == {"a": (1, "x")}
    assert t.upsert(make(("b", 2, "y")), 6) and held(t) == {"a": (1, "x"), "b": (2, "y")}


def test_a_stream_that_fails_and_is_run_again(spark, tmp_path, monkeypatch):
    """The second batch fails after its rows are written, and the third after the log names it: nothing is lost or doubled."""
    schema = "id string, v int, note string, at int"
    for i, rows in enumerate(([("a", 1, "x", 0), ("a", 2, "y", 1)], [("a", 0, "z", 2), ("b", 1, "x", 3)], [("b", 5, "w", 4), ("b", 4, "u", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "id")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    note, count = KeyedTable._note, {"n": 0}

    def failing(self, batch, kind):
        count["n"] += kind == "upsert"
        if count["n"] == 2:
            raise RuntimeError("before the log")
        note(self, batch, kind)
        if count["n"] == 4:
            raise RuntimeError("after the log")

    monkeypatch.setattr(KeyedTable, "_note", failing)
    for expected in ("before the log", "after the log"):
        with pytest.raises(Exception, match=expected):
            upsert_stream(stream(), t, f"{tmp_path}/state", ["at"]).awaitTermination()
    monkeypatch.setattr(KeyedTable, "_note", note)
    upsert_stream(stream(), t, f"{tmp_path}/state", ["at"]).awaitTermination()
    assert held(t) == {"a": (0, "z"), "b": (4, "u")}
    assert [kind for _, kind in t.log()] == ["create", "upsert", "upsert", "upsert"]
