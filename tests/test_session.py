from __future__ import annotations

from types import SimpleNamespace

import pytest

from panelwright.session import shared_folder


def session(master, folder):
    unset = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, _jsc=jsc))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None), "x")
        assert shared_folder(session(master, "hdfs://shared"), "x").startswith("hdfs://shared/x-")
    assert shared_folder(session("local[8]", None), "x")
