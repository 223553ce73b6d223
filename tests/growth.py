"""What a query moves, for tests of how it grows."""

from __future__ import annotations


def moved(spark, run) -> tuple[int, int]:
    """Rows and bytes that all stages of run() wrote for shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    run()
    new = [s for at, s in stages().items() if at not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def made(spark, run) -> int:
    """The most rows that one operator of run() put out."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {e.executionId(): e for e in (found.apply(i) for i in range(found.size()))}

    before, most = set(executions()), 0
    run()
    for at, execution in executions().items():
        if at in before:
            continue
        values, metrics = store.executionMetrics(at), execution.metrics()
        for m in (metrics.apply(i) for i in range(metrics.size())):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).split()[0].replace(",", "")))
    return most
