import os

import pytest

from weftgraph.sources import shared


def test_scratch_tables(spark, monkeypatch):
    monkeypatch.setattr(shared, "_MADE", {})  # tables of other tests stay
    s = shared.Scratch(spark)
    one, two = s.save(spark.range(5), "one"), s.save(spark.range(0), "two")
    assert one.count() == 5 and two.count() == 0 and s.path.startswith(shared.shared_dir(spark))
    s.drop("one")
    assert os.listdir(s.path) == ["two"]
    shared.release(spark)
    assert not os.path.exists(s.path)


class Named:
    """What shared_dir() asks of a session that names no folder."""

    def __init__(self, master, app):
        self.conf = self.sparkContext = self
        self.master, self.applicationId = master, app

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self


def test_cluster_without_shared_folder_raises(monkeypatch):
    monkeypatch.setattr(shared, "_LOCAL", {})
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_dir(Named(master, "x"))
    once = shared.shared_dir(Named("local[4]", "y"))
    assert os.path.isdir(once) and shared.shared_dir(Named("local[4]", "y")) == once
    os.rmdir(once)
