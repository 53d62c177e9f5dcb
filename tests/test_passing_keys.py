"""Queries that seal and open what they need themselves, on a cluster whose session holds no key."""

import pytest

from tessera.operators import archive, workspace
from tessera.operators.staging import shared_dir
from tests import test_oracles
from tests.test_oracles import duck  # noqa: F401  a fixture


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as a cluster's: no local master, and no key in the settings."""
    shared_dir(spark)
    before = spark.conf.get(archive.KEY_SETTING, None)
    spark.conf.unset(archive.KEY_SETTING)
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    yield spark
    spark.conf.unset(archive.KEY_SETTING)
    if before is not None:
        spark.conf.set(archive.KEY_SETTING, before)


@pytest.mark.parametrize("name", ["cold_roundtrip", "cold_search", "hybrid_search", "migration_execute", "sensitive_text_roundtrip", "workspace_entries"])
def test_query_needs_no_stored_key(cluster, duck, name):  # noqa: F811
    test_oracles.test_query(cluster, duck, name)
    assert cluster.conf.get(archive.KEY_SETTING, None) is None  # what is made in passing never becomes the key of stored archives
    with pytest.raises(ValueError):
        archive.key(cluster)
    with pytest.raises(ValueError):
        workspace.SealedEntries(cluster, "file:///nowhere")


def test_a_key_that_is_set_is_taken(cluster):
    cluster.conf.set(archive.KEY_SETTING, "0123456789abcdef0123456789abcdef")
    keys = cluster.range(1).select(archive.key(cluster).alias("a"), archive.passing_key(cluster).alias("b")).collect()[0]
    assert keys["a"] == keys["b"] == "0123456789abcdef0123456789abcdef"
