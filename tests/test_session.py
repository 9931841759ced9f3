"""The session helper sets no master or memory of its own and asks for a shared checkpoint folder on clusters."""
import pytest

from ledgerlens import session as S


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class _Session:
    def __init__(self, master, conf=()):
        self.conf = _Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "dir": None, "getCheckpointDir": lambda s: s.dir,
                                           "setCheckpointDir": lambda s, d: setattr(s, "dir", d)})()


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(_Session(master))
    named = _Session(master, {"spark.checkpoint.dir": "file:///shared/x/"})
    assert S.ensure_checkpoint_dir(named) == "file:///shared/x"
    assert named.sparkContext.dir == "file:///shared/x/"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_gets_a_private_folder(master):
    s = _Session(master)
    assert S.ensure_checkpoint_dir(s) == s.conf["spark.checkpoint.dir"] == s.sparkContext.dir


def test_scratch_paths_are_unique(spark):
    assert S.scratch_path(spark, "x") != S.scratch_path(spark, "x")


def test_no_master_or_memory_is_forced(monkeypatch):
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            seen["master"] = m
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):
            s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///x"})
            s.sparkContext.setLogLevel = lambda level: None
            return s

    monkeypatch.setattr(S, "SparkSession", type("X", (), {"builder": Builder()}))
    S.get_spark()
    assert "master" not in seen and not any("memory" in k for k in seen)
    S.get_spark("local[2]")
    assert seen["master"] == "local[2]"
