from leafmill.llm.common import driver_gives_back, trimmed


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_workers_give_back_what_they_freed():
    """Blocks that were freed below ones still in use stay with the process unless it gives them back."""
    pins = []

    def run(batches):
        blocks = []
        for _ in range(2000):
            blocks.append(b"x" * 50_000)
            pins.append(b"y" * 600)
        yield len(blocks)

    before = resident()
    assert list(trimmed(run)([])) == [2000]
    assert resident() - before < 50_000_000


def test_driver_gives_back_what_its_jobs_left(spark):
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    driver_gives_back(spark)
    for _ in range(4):
        spark.sparkContext._jvm.java.lang.String("x" * 10_000_000)
    before = runtime.totalMemory() - runtime.freeMemory()
    driver_gives_back(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < before - 20_000_000
