from __future__ import annotations

from braidwork.session import ship


def test_package_reaches_the_executors(spark):
    assert ship(spark) is spark and ship(spark) is spark
    found = spark.range(4, numPartitions=4).mapInPandas(lambda it: (d.assign(id=len(__import__("braidwork").__doc__)) for d in it), "id long").collect()
    assert len(found) == 4 and all(r.id > 0 for r in found)
