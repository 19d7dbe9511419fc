"""The driver's JVM gives back heap that an earlier step has grown to."""

import gc

from loamline.llm.base import settle


def test_heap_is_given_back_between_steps(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    held = [spark._jvm.java.nio.ByteBuffer.allocate(runtime.maxMemory() // 20) for _ in range(12)]
    assert runtime.totalMemory() > runtime.maxMemory() / 2
    held.clear()
    gc.collect()
    assert settle(spark.range(10), "ids").count() == 10
    assert runtime.totalMemory() < runtime.maxMemory() / 2
