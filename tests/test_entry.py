import subprocess
import sys

import __spark_entry__ as entry


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120 and "metrics_at_k" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "hitrate", "recall", "iou"] and df.count() == 20


def test_nothing_outside_imports_the_subpackage():
    code = "import sys, siftwell.plans.registry, siftwell.sources.sinks, siftwell.streaming.windows, siftwell.operators.learn; assert not [m for m in sys.modules if 'llm' in m]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.ROOT)
