import pytest

from adlumen import schemas
from adlumen.operators.catalog import upsert_brands
from adlumen.sources.brands import BrandStore

FORM = ("form_ord int, brand_id string, brand_name string, tone_category string, brand_voice_summary string, style_rules string, "
        "preferred_vocabulary string, forbidden_vocabulary string, reference_ad_copies string")


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["brand_id"])


def test_what_is_read_back_is_what_was_upserted(spark, tmp_path):
    store = BrandStore(spark, str(tmp_path / "brands"))
    assert store.read().count() == 0 and store.read().schema == schemas.BRAND and store.versions() == []
    first = spark.createDataFrame([
        (1, "a", "Ay", "", "v", "", "x, y", "", "one\ntwo"), (2, "b", "Be", "Bold", "", "r1\nr2", "", "no", "three"),
        (3, "", "none", "", "", "", "", "", "z")], FORM)
    assert [r.form_ord for r in store.upsert(first).collect()] == [3]
    second = spark.createDataFrame([(4, "b", "Bee", "Calm", "", "", "", "", "four"), (5, "c", "Ce", "", "", "", "", "", "five")], FORM)
    merged, _ = upsert_brands(store.read(), second)
    expected = rows(merged)
    assert store.upsert(second).count() == 0 and rows(store.read()) == expected and len(expected) == 3
    assert [r["brand_name"] for r in rows(store.read(1))] == ["Ay", "Be"] and store.versions() == [1, 2]
    assert rows(store.read())[0]["reference_ad_copies"] == ["one", "two"]
    assert store.upsert(first.where("brand_id = ''")).count() == 1 and store.versions() == [1, 2]  # nothing to save


def test_a_save_that_dies_changes_nothing(spark, tmp_path):
    store = BrandStore(spark, str(tmp_path / "brands"))
    form = spark.createDataFrame([(1, "a", "Ay", "", "", "", "", "", "one")], FORM)
    store.upsert(form)
    store.upsert(form.replace("Ay", "Lost"))
    (tmp_path / "brands" / "version-2" / "_SUCCESS").unlink()  # as if the job had died before its commit
    assert store.versions() == [1] and [r["brand_name"] for r in rows(store.read())] == ["Ay"]
    with pytest.raises(ValueError, match="no version 2"):
        store.read(2)
    store.upsert(form.replace("Ay", "Next"))
    assert store.versions() == [1, 3] and [r["brand_name"] for r in rows(store.read())] == ["Next"]
    assert store.prune(keep=1) == [1, 2] and store.versions() == [3]
    with pytest.raises(ValueError):
        store.prune(keep=0)
