"""Stages of the pipeline begin with executors that have collected their garbage."""

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_collects_garbage_first(spark, name, stage):
    class Begun(Exception):
        pass

    class Docs:
        def __getattr__(self, _):
            raise Begun  # the stage's own work begins

    before = full_collections(spark)
    with pytest.raises(Begun):
        stage(spark, Docs(), DATA)
    assert full_collections(spark) > before
