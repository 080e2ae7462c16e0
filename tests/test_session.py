"""Intermediate data lives in the shared folder and can be removed from it."""

import os
from types import SimpleNamespace

import pytest

from tablewright import session


def files_below(folder):
    return [f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names]


def test_discard_leaves_nothing(spark):
    table = session.written_once(spark.range(10))
    folder = table._written_to
    assert table.count() == 10 and files_below(folder)
    session.discard(table)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_a_scope_deletes_its_own_tables_only(spark):
    other = session.written_once(spark.range(7))
    outer, inner = session.Scratch(), session.Scratch()
    with outer:
        first = session.written_once(spark.range(3))
        with inner:
            nested = session.written_once(spark.range(4))
        read = session.written_once(spark.range(5))
    after = session.written_once(spark.range(6))
    outer.discard(spark, keep=read.where("id > 1"))
    assert not os.path.exists(first._written_to.removeprefix("file:"))
    assert [t.count() for t in (other, nested, read, after)] == [7, 4, 5, 6] and outer.folders == [read._written_to]
    inner.discard(spark)
    assert not os.path.exists(nested._written_to.removeprefix("file:")) and other.count() == 7


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        conf = SimpleNamespace(get=lambda name, default: default)
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=context))
