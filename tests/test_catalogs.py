import json

from lodestone.sources import catalogs


def card(i, name, **more):
    return {"id": i, "name": name, "set": "abc", "set_name": "Alphabet", "image_uris": {"small": f"u/{i}"}, **more}


def test_a_catalog_is_loaded_once_and_refreshed(spark, tmp_path):
    source, store = f"{tmp_path}/raw", f"{tmp_path}/store"
    (tmp_path / "raw").mkdir()
    lines = [json.dumps(card("A1", "first")), "", "{broken", json.dumps({"name": "no id"}), json.dumps(card("b2", "other")), json.dumps(card("a1", "last face", cmc=2.0))]
    (tmp_path / "raw/cards.json").write_text("\n".join(lines))
    read = lambda **how: {r["id"]: (r["name"], r["set_code"], r["set_name"], r["img_uri"]) for r in catalogs.load(spark, source, store, **how).collect()}
    want = {"a1": ("last face", "abc", "Alphabet", "u/a1"), "b2": ("other", "abc", "Alphabet", "u/b2")}
    assert read() == want
    assert json.loads(catalogs.load(spark, source, store).where("id = 'a1'").first()["payload"])["cmc"] == 2.0
    (tmp_path / "raw/cards.json").write_text(json.dumps(card("c3", "new")))
    assert read() == want  # the store is read, not the source
    assert read(refresh=True) == {"c3": ("new", "abc", "Alphabet", "u/c3")}


def test_a_catalog_in_one_array(spark, tmp_path):
    (tmp_path / "bulk.json").write_text(json.dumps([card("x", "one"), card("y", "two", prices={"usd": "0.20"})], indent=1))
    rows = catalogs.load(spark, f"{tmp_path}/bulk.json", f"{tmp_path}/store", lines=False)
    assert {r["id"]: r["name"] for r in rows.collect()} == {"x": "one", "y": "two"}
    (tmp_path / "bad.json").write_text("[1,")
    assert catalogs.load(spark, f"{tmp_path}/bad.json", f"{tmp_path}/none", lines=False).count() == 0
