from types import SimpleNamespace

import pytest

from bomloom import runtime


def _session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,4,6144]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(_session(master))
        assert runtime.shared_dir(_session(master, "hdfs:///shared/")) == "hdfs:///shared"


def test_a_local_master_may_use_its_own_folder():
    assert runtime.shared_dir(_session("local[8]")).startswith("file:///")
