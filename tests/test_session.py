from types import SimpleNamespace

import pytest

from vigil.session import ensure_checkpoint_dir


def session(master, configured=None):
    """A session's parts that the checkpoint folder depends on."""
    at = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: at[0] if at else None, setCheckpointDir=at.append,
                         getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: configured))


def test_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(session("spark://a:1", "hdfs:///shared")) == "hdfs:///shared"
    assert "vigil-ckpt-" in ensure_checkpoint_dir(session("local[2]"))
    for master in ("spark://a:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master))
