import pytest

from lodestrata import session


class _Context:
    master, applicationId = "spark://host:7077", "app"

    def getCheckpointDir(self):
        return None


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    sparkContext, conf = _Context(), _Conf()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session())


def test_the_folder_of_the_context_is_used(monkeypatch):
    monkeypatch.setattr(_Context, "getCheckpointDir", lambda self: "hdfs://name/ck/")
    assert session.shared_dir(_Session()) == "hdfs://name/ck"


def test_stages_go_at_the_end_of_their_scope(spark):
    import os

    with session.stage_scope(spark):
        df = session.staged(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.exists("/" + path.lstrip("/"))
    assert not os.path.exists("/" + path.lstrip("/"))
