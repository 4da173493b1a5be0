"""Deletes from stored tables follow the foreign keys and leave readers a whole version."""

import pytest
from pyspark.sql import functions as F

from riskloom.sources import versioned
from riskloom.sources.versioned import Table, Versions

TABLES = [
    Table("orders", "id"),
    Table("lines", "line", "orders", "order_id"),
    Table("notes", "note", "lines", "line_id"),
    Table("extras", "id", "orders", "id"),
]


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "GROUP_ROWS", 25)
    versions = Versions(spark, str(tmp_path / "v"), TABLES)
    ids = spark.range(100)
    versions.load(
        {
            "orders": ids.select("id", (F.col("id") * 2).alias("v")),
            "lines": spark.range(300).select(F.col("id").alias("line"), (F.col("id") % 100).alias("order_id")),
            "notes": spark.range(60).select(F.col("id").alias("note"), (F.col("id") * 5).alias("line_id")),
            "extras": ids.filter("id < 10").select("id"),
        }
    )
    return versions


def held(stored, version=None):
    return {t.name: sorted(r[0] for r in stored.read(t.name, version).select(t.key).collect()) for t in TABLES}


def without(gone):
    lines = [i for i in range(300) if i % 100 not in gone]
    return {
        "orders": [i for i in range(100) if i not in gone],
        "lines": lines,
        "notes": [n for n in range(60) if n * 5 in lines],
        "extras": [i for i in range(10) if i not in gone],
    }


def test_cascade_and_untouched_groups(spark, stored):
    before = stored.groups(0)
    assert len(before["orders"]) == 4
    keys = spark.createDataFrame([(3,), (7,), (3,), (1000,)], "id long")
    for _ in range(2):
        stored.delete("orders", keys, 1)
        assert held(stored) == without({3, 7}) and stored.newest() == 1
        assert held(stored, 0) == without(set())
    after = stored.groups(1)
    assert len(set(before["orders"]) - set(after["orders"])) == 1  # only the group of 3 and 7 is written anew
    assert stored.read("orders").columns == ["id", "v"]


def test_a_version_that_is_not_committed_is_not_read(spark, stored, tmp_path):
    (tmp_path / "v/versions/run=5").mkdir()
    assert stored.newest() == 0 and held(stored) == without(set())


def test_delete_all_and_children_only(spark, stored):
    stored.delete("lines", spark.range(300).toDF("line"), 1)
    found = held(stored)
    assert found["lines"] == found["notes"] == [] and len(found["orders"]) == 100 and len(found["extras"]) == 10
    stored.delete("orders", spark.range(0).toDF("id"), 2)
    assert held(stored) == found
    stored.forget(2)
    assert held(stored) == found and stored.newest() == 2
