"""Enriching items, and doing it again only where something has changed."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import enrichment as e
from tidemark.sources import stored

ITEM = "id long, title string, body string, tags array<string>, stated_country string, stated_confidence double, stated_source string"
LISTS = {"en": ["the", "and", "with"], "tr": ["bir", "ve", "ile", "bu", "için"]}
TURKISH = "bu bir deneme ve bir haber için yazı ile"


def incoming(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_fields_of_an_item(spark):
    rows = [(1, "The flood and the river", "The flood grows #Flood #river with rain", ["flood", "flood"], None, None, None), (2, TURKISH, None, None, None, None, None), (3, TURKISH, "", None, "DE", 0.9, "platform"), (4, None, None, None, None, None, None), (5, "ﬂood ﬂood １２ the", "", [], None, None, None)]
    got = {r["id"]: r for r in e.enriched(incoming(spark, rows), LISTS).collect()}
    one = got[1]
    assert one["lang"] == "en" and one["keywords"][0] == "flood" and one["hashtags"] == ["flood", "river"] and one["country"] is None and one["country_source"] is None
    assert (got[2]["lang"], got[2]["country"], got[2]["country_source"]) == ("tr", "TR", "language") and 0 < got[2]["country_confidence"] <= 0.35
    assert (got[3]["country"], got[3]["country_confidence"], got[3]["country_source"]) == ("DE", 0.9, "platform")
    assert (got[4]["lang"], got[4]["lang_confidence"], got[4]["keywords"], got[4]["hashtags"], got[4]["simhash"]) == (None, None, [], [], 0)
    assert got[5]["keywords"] == ["flood"]  # composed before it is read
    assert set(e.FIELDS) <= set(got[1].asDict()) and "stated_country" in got[1].asDict()


def test_digest_of_tokens_is_that_of_both_functions(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "c", "é", "z"]), (2, []), (3, None)], "id long, w array<string>")
    got = {r["id"]: r for r in rows.select("id", t.token_digest("w").alias("d"), t.simhash("w").alias("s")).collect()}
    assert got[1]["d"]["simhash"] == got[1]["s"] and got[1]["d"]["keywords"] == ["b", "c", "a", "z", "é"]
    assert got[2]["d"]["keywords"] == [] and got[2]["d"]["simhash"] == 0 and got[3]["s"] is None


@pytest.fixture()
def kept(spark, tmp_path):
    table = stored.StoredTable(spark, f"file://{tmp_path}/items", stored.buckets(["id"], 8))
    rows = [(i, TURKISH if i % 2 else "the rain and the river with mud", None, None, "FR" if i == 3 else None, 1.0 if i == 3 else None, "platform" if i == 3 else None) for i in range(20)]
    items = e.enriched(incoming(spark, rows), LISTS).withColumn("digest", e.digest()).withColumn("rules", F.lit(e.RULES))
    table.put(items.drop("stated_country", "stated_confidence", "stated_source"))
    return table


def test_nothing_stale_writes_nothing(kept):
    before = kept.version()
    assert e.reenriched(kept, lists=LISTS) == e.Swept(20, 0, 0)
    assert kept.version() == before


def test_changed_texts_are_worked_out_again(spark, kept):
    changed = kept.read().where("id in (3, 5)").withColumn("title", F.lit("the rain and the river with mud"))
    kept.upsert(changed, stored.newest_by(["id"]))
    before = kept.version()
    assert e.reenriched(kept, lists=LISTS) == e.Swept(20, 2, 2)
    after = kept.version()
    touched = {r[0] for r in spark.createDataFrame([(3,), (5,)], "id long").select(F.expr(kept.part)).collect()}
    assert {p for p in after.parts if after.parts[p] != before.parts[p]} == touched
    got = {r["id"]: r for r in kept.read().collect()}
    assert len(got) == 20 and got[5]["lang"] == "en" and got[5]["country"] is None  # the language's country goes with it
    assert got[3]["lang"] == "en" and (got[3]["country"], got[3]["country_source"]) == ("FR", "platform")  # the source's stays
    assert got[7]["country"] == "TR" and e.reenriched(kept, lists=LISTS).stale == 0


def test_new_rules_take_every_row_once(kept):
    assert e.reenriched(kept, rules=e.RULES + 1, lists=LISTS).stale == 20
    assert e.reenriched(kept, rules=e.RULES + 1, lists=LISTS).stale == 0
