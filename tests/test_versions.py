"""Replacing tables that are being read."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallwise.sources import versions

BROKEN = "CASE WHEN id = 7 THEN raise_error('broken row') ELSE id END AS id"


@pytest.fixture
def name(spark):
    name = f"versioned_{abs(hash(id(object())))}"
    yield name
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    versions.forget_versions(spark, name, keep=0)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_readers_keep_their_version(spark, name):
    versions.replace_table(spark.range(3), name)
    old = spark.table(name)
    plain = spark.sql(f"SELECT id FROM {name} WHERE id > 0")
    versions.replace_table(spark.range(10, 12), name)
    assert ids(old) == [0, 1, 2] and ids(plain) == [1, 2]
    assert ids(spark.table(name)) == [10, 11]


def test_table_may_be_made_from_itself(spark, name):
    versions.replace_table(spark.range(3), name)
    versions.replace_table(spark.table(name).select((F.col("id") * 2).alias("id")), name)
    assert ids(spark.table(name)) == [0, 2, 4]


def test_schema_may_change(spark, name):
    versions.replace_table(spark.range(3), name)
    versions.replace_table(spark.range(2).select(F.lit("x").alias("text")), name)
    assert spark.table(name).columns == ["text"] and spark.table(name).count() == 2


@pytest.mark.parametrize("outside", [False, True])
def test_failed_write_changes_nothing(spark, name, tmp_path, outside):
    folder = str(tmp_path) if outside else None
    first = versions.replace_table(spark.range(3), name, folder=folder)
    with pytest.raises(Exception, match="broken row"):
        versions.replace_table(spark.range(20).selectExpr(BROKEN), name, folder=folder)
    assert ids(spark.table(name)) == [0, 1, 2]
    assert versions.versions(spark, name) == [first] and versions.current_version(spark, name) == first
    if outside:
        assert [p.name for p in tmp_path.iterdir()] == [first]


def test_failed_first_write_leaves_no_table(spark, name):
    with pytest.raises(Exception, match="broken row"):
        versions.replace_table(spark.range(20).selectExpr(BROKEN), name)
    assert not spark.catalog.tableExists(name) and versions.current_version(spark, name) is None
    assert versions.versions(spark, name) == []


def test_old_versions_are_forgotten_with_their_files(spark, name, tmp_path):
    made = [versions.replace_table(spark.range(n), name, folder=str(tmp_path)) for n in range(1, 5)]
    assert versions.versions(spark, name) == made
    versions.point_to(spark, name, made[0])
    assert ids(spark.table(name)) == [0]
    # The current one stays, whatever its age.
    assert versions.forget_versions(spark, name, keep=1) == made[1:3]
    assert sorted(p.name for p in Path(tmp_path).iterdir()) == [made[0], made[3]]
    versions.point_to(spark, name, made[3])
    assert versions.forget_versions(spark, name, keep=0) == made[:1]
    assert ids(spark.table(name)) == [0, 1, 2, 3]


def test_writers_at_once_each_write_a_whole_version(spark, name):
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda n: versions.replace_table(spark.range(n * 100, n * 100 + 50), name), range(1, 5)))
    assert sorted(made) == versions.versions(spark, name)
    shown = ids(spark.table(name))
    assert versions.current_version(spark, name) in made and len(shown) == 50 and shown[0] % 100 == 0


def test_buckets_carry_through_the_view(spark, name):
    versions.replace_table(spark.range(100).withColumn("v", F.lit(1)), name, bucket_by="id", buckets=4)
    plan = spark.table(name).groupBy("id").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_partitions_and_databases(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_apart")
    frame = spark.range(6).withColumn("part", F.col("id") % 2)
    version = versions.replace_table(frame, "kept_apart.things", partition_by=("part",))
    assert versions.current_version(spark, "kept_apart.things") == version
    assert versions.versions(spark, "kept_apart.things") == [version] and versions.versions(spark, "things") == []
    assert ids(spark.table("kept_apart.things").where("part = 1")) == [1, 3, 5]
    spark.sql("DROP DATABASE kept_apart CASCADE")


def test_plain_tables_are_not_taken_over(spark, name):
    spark.range(2).write.saveAsTable(name)
    with pytest.raises(ValueError, match="not a view"):
        versions.replace_table(spark.range(3), name)
    assert ids(spark.table(name)) == [0, 1]
    spark.sql(f"DROP TABLE {name}")
