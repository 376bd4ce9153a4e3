"""Folders for written intermediates."""

import types

import pytest

from facadelake import session


def fake(master, root=None):
    settings = {"spark.master": master} | ({"spark.checkpoint.dir": root} if root else {})
    get = lambda key, default=None: settings.get(key, default)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=get), sparkContext=types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(get=get)))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.work_dir(fake(master), "x")
        assert session.work_dir(fake(master, "hdfs://n/shared/"), "x").startswith("hdfs://n/shared/facadelake/x-")
    for master in ("local", "local[8]", "local[*]"):
        assert "facadelake-x-" in session.work_dir(fake(master), "x")
