import os

import pytest

from lakeloom.llm import common


class Cluster:
    """A session that says it runs on a cluster without a shared folder."""

    def __init__(self, spark):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: self)})()})()

    def getCheckpointDir(self):
        return type("None_", (), {"isEmpty": staticmethod(lambda: True)})()


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster(spark))


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_stored_tables_go_when_they_are_used_up(spark):
    scratch = common.Scratch()
    made = []

    def build():
        inner = common.stored(spark.range(10))
        made.append(folder(inner))
        return inner.where("id > 4")

    kept = scratch.alone(build)
    at = folder(kept)
    assert kept.count() == 5 and os.path.isdir(at) and not os.path.isdir(made[0])
    scratch.drop(kept)
    assert not os.path.isdir(at)


def test_alone_deletes_only_what_it_made(spark):
    before = common.stored(spark.range(3))
    known = set(common._made)
    scratch = common.Scratch()
    result = scratch.alone(lambda: common.stored(common.stored(before).select("id")).limit(2))
    assert set(common._made) - known == {scratch.held[0][1]} and before.count() == 3 and result.count() == 2
    scratch.clear()
    assert set(common._made) == known
