from types import SimpleNamespace

import pytest

from graphloom.session import ensure_checkpoint_dir


def fake(master, named=None, by_hand=None):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: by_hand, setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named)), seen


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_mode_makes_a_folder(master):
    session, seen = fake(master)
    ensure_checkpoint_dir(session)
    assert len(seen) == 1 and seen[0].startswith("file:///")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake(master)[0])
    session, seen = fake(master, "hdfs:///shared")
    ensure_checkpoint_dir(session)
    assert seen == ["hdfs:///shared"]
    session, seen = fake(master, None, "hdfs:///by-hand")
    ensure_checkpoint_dir(session)
    assert seen == []
