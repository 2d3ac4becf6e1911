import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import positions
from rankspark.plans import stage


@pytest.mark.parametrize("split", [10**6, 10])
def test_running_sums_of_split_groups(spark, monkeypatch, split):
    """One group over all partitions, small ones and a null one; both ways give the same."""
    monkeypatch.setattr(positions, "SPLIT", split)
    rnd = random.Random(split)
    rows = [(rnd.choice(["hot"] * 8 + ["b", "c", None]), i, rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(7)
    got = positions.running(df, ["k"], [F.desc("at")], {"n": F.lit(1), "s": F.col("x")}, positions.largest_group(df, ["k"]))
    want, n, s = {}, {}, {}
    for k, at, x in sorted(rows, key=lambda r: -r[1]):
        n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0) + x
        want[at] = (k, n[k], s[k])
    assert {r["at"]: (r.k, r.n, r.s) for r in got.collect()} == want
    assert positions.running(df.limit(0), ["k"], [F.desc("at")], {"n": F.lit(1)}, 0).count() == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        stage.ensure_checkpoint_dir(Session)


def test_broadcast_only_what_is_measured_to_be_small(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).select("id", F.repeat(F.lit("x"), F.lit(1000)).alias("a.b"))
    assert hinted(stage.maybe_broadcast(few)) and not hinted(stage.maybe_broadcast(few, limit=9)) and not hinted(stage.maybe_broadcast(few, size=5000))
