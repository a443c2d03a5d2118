"""Intermediate tables."""

import types

import pytest

from docweave import runtime


def _session(master, folder=None):
    context = types.SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: folder)
    held = {}
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: held.get(k, d), set=held.__setitem__), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_folder(_session(master))
    assert runtime.shared_folder(_session(master, "hdfs://x/shared/")) == "hdfs://x/shared/docweave-a"


def test_local_sessions_get_one_of_their_own():
    session = _session("local[4]")
    assert runtime.shared_folder(session).startswith("file:") and runtime.shared_folder(session) == runtime.shared_folder(session)


def test_settled_rows_are_kept_until_cleaned(spark):
    rows = runtime.settled(spark.range(5))
    assert rows.count() == 5
    runtime.clean(spark)
    with pytest.raises(Exception, match=r"(?i)not.?exist|not.?found"):
        rows.collect()
