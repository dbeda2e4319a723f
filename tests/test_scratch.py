"""Scratch tables: where they may be, and that they go."""

from types import SimpleNamespace

import pytest

from quillgraph.plans import scratch


class Settings(dict):
    def set(self, key, value):
        self[key] = value


def session(master):
    settings = Settings()
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {}), conf=SimpleNamespace(get=settings.get, set=settings.set))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(session(master))


def test_one_machine_has_a_folder_of_its_own():
    assert scratch.shared_folder(session("local[2]")).startswith("file://")


def test_tables_are_written_and_dropped(spark):
    before = scratch.live()
    df = scratch.materialise(spark.range(10), "numbers")
    assert df.count() == 10 and len(scratch.live()) == len(before) + 1
    scratch.drop(df)
    assert scratch.live() == before
