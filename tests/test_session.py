"""The shared folder is named, or the session is local."""

import pytest

from chartloom.session import checkpoint_dir


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext, self._conf = _Context(master), conf or {}

    @property
    def conf(self):
        return self._conf


def test_cluster_needs_a_named_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session("spark://host:7077"))
    assert checkpoint_dir(_Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert checkpoint_dir(_Session("spark://host:7077"), "s3a://b/x") == "s3a://b/x"
    assert checkpoint_dir(_Session("local[2]"))
