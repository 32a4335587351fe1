"""Where intermediate tables may lie."""

from __future__ import annotations

import pytest

from stallwise.sources import staging


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


@pytest.mark.parametrize(
    "conf, folder",
    [
        ({"spark.checkpoint.dir": "hdfs:///c", "spark.sql.warehouse.dir": "file:/w", "spark.master": "yarn"}, "hdfs:///c"),
        ({"spark.sql.warehouse.dir": "file:/w", "spark.master": "local[4]"}, "file:/w/staging"),
        ({"spark.sql.warehouse.dir": "s3a://bucket/w/", "spark.master": "yarn"}, "s3a://bucket/w/staging"),
        ({"spark.sql.warehouse.dir": "/w", "spark.master": "yarn", "spark.hadoop.fs.defaultFS": "hdfs://h"}, "/w/staging"),
    ],
)
def test_shared_folder(conf, folder):
    session = Session()
    session.conf = conf
    assert staging.shared_folder(session) == folder


@pytest.mark.parametrize("warehouse", ["file:/w", "file:///w/", "/w"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(warehouse):
    session = Session()
    session.conf = {"spark.sql.warehouse.dir": warehouse, "spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(session)


def test_recorded_folders_can_be_removed(spark):
    before = staging.stage(spark.range(3), "before")
    with staging.recorded() as outer:
        one = staging.stage(spark.range(4), "one")
        with staging.recorded() as inner:
            two = staging.stage(spark.range(5), "two")
    three = staging.stage(spark.range(6), "three")
    assert len(outer) == 2 and inner == outer[1:]
    staging.remove(spark, inner)
    assert [f.count() for f in (before, one, three)] == [3, 4, 6]
    with pytest.raises(Exception, match="(?i)not exist|not_exist"):
        two.count()
