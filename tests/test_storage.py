import os

import pytest

from conftest import rows
from tidemark import storage


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(storage.NoSharedFolder):
            storage.own_dir(master)
    assert storage.own_dir("local[2]").startswith("file://")


def test_the_named_folder_is_used_and_tables_are_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "named_dir", lambda _: f"file://{tmp_path}/")
    made = storage.materialize(spark.range(3), "three")
    assert rows(made) == [(0,), (1,), (2,)]
    folder = made._tidemark_path.removeprefix("file://")
    assert folder.startswith(str(tmp_path)) and os.path.isdir(folder)
    storage.discard(made)
    assert not os.path.exists(folder)
