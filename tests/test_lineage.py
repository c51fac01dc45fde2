import pytest

from auditlake import lineage


class Session:
    """The settings of a session, without one."""

    def __init__(self, **settings):
        self.conf = {"spark." + k.replace("_", "."): v for k, v in settings.items()}


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        lineage.ensure_checkpoint_dir(Session(master=master, sql_warehouse_dir="file:/tmp/warehouse"))
    assert lineage.ensure_checkpoint_dir(Session(master=master, sql_warehouse_dir="hdfs://n/warehouse/")) == "hdfs://n/warehouse/checkpoints"
    assert lineage.ensure_checkpoint_dir(Session(master=master, sql_warehouse_dir="/tmp/w", checkpoint_dir="file:///shared")) == "file:///shared"


def test_local_mode_uses_the_warehouse():
    for master in ("local", "local[4]", "local[*]"):
        assert lineage.ensure_checkpoint_dir(Session(master=master, sql_warehouse_dir="/tmp/w")) == "/tmp/w/checkpoints"


def test_tables_and_files_go_when_released(spark):
    kept = lineage.cut(spark.range(3))
    name = kept._cut_name
    spark.range(2).write.parquet(lineage.folder(spark))
    assert kept.count() == 3 and spark.catalog.tableExists(name)
    lineage.release(kept)
    assert not spark.catalog.tableExists(name)
