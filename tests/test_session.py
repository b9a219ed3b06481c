"""Storing a table collects the garbage of its job in a driver that has grown large."""

import time

from panelspark.session import relieved, stored


def _full_collections(java):
    beans = java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_storing_collects_in_a_large_heap_only(spark):
    java = spark._jvm.java
    runtime = java.lang.Runtime.getRuntime()
    java.lang.System.gc()
    small = runtime.totalMemory() <= runtime.maxMemory() // 2
    before = _full_collections(java)
    stored(spark.range(10))
    assert not small or _full_collections(java) == before
    held = []
    while runtime.totalMemory() <= runtime.maxMemory() // 2:
        held.append(java.util.BitSet(1 << 30))  # 128 MB each
    before = _full_collections(java)
    stored(spark.range(10))
    assert _full_collections(java) > before
    for one in held:
        spark.sparkContext._gateway.detach(one)


def test_released_shuffles_leave_no_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllBlocks()
        return {name for i in range(found.size()) if (name := found.apply(i).name()).startswith("shuffle_")}

    before = shuffled()
    stored(spark.range(1000).repartition(3, "id"))
    assert shuffled() - before
    relieved(spark, always=True)
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
