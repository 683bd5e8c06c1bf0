import uuid

import pytest

from cartloom.operators.state_table import keyed_state

ROW = "k int, h string, body string"


def compute(df):
    return df.selectExpr("k", "h", "upper(body) AS payload")


@pytest.fixture
def state(spark, tmp_path):
    held = keyed_state(spark, f"state_{uuid.uuid4().hex}", str(tmp_path / "state"), key="int", buckets=4)
    yield held
    held.drop()


def rows(df):
    return sorted((r.key or 0, r.hash, r.payload) for r in df.collect())


def test_only_changes_are_written(spark, state):
    first = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (None, "n", "null"), (4, None, "no hash")], ROW)
    want = [(0, "n", "NULL"), (1, "a", "ONE"), (2, "b", "TWO"), (4, None, "NO HASH")]
    assert rows(state.refresh(first, "k", "h", compute)) == want
    assert rows(state.refresh(first, "k", "h", compute)) == want and state.rows().count() == 4
    second = spark.createDataFrame([(1, "a2", "uno"), (None, "n", "other"), (4, None, "other"), (3, "c", "three")], ROW)
    kept = state.refresh(second, "k", "h", compute, keep_missing=True)
    assert rows(kept) == [(0, "n", "NULL"), (1, "a2", "UNO"), (2, "b", "TWO"), (3, "c", "THREE"), (4, None, "NO HASH")]
    assert rows(state.refresh(second, "k", "h", compute)) == [r for r in rows(kept) if r[0] != 2]
    # one row changed, one is new, one is gone
    assert state.rows().count() == 4 + 2 + 1
    back = second.unionByName(spark.createDataFrame([(2, "b", "again")], ROW))
    assert (2, "b", "AGAIN") in rows(state.refresh(back, "k", "h", compute))


def test_the_state_is_not_shuffled(spark, state):
    now = spark.createDataFrame([(i, f"h{i}", "x") for i in range(50)], ROW)
    state.refresh(now, "k", "h", compute)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (state.changed(now, "k", "h"), state.vanished(now, "k"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        lines = plan.split("\n")
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        deepest = depth[at]
        for i in range(at, -1, -1):
            if depth[i] < deepest:
                deepest = depth[i]
                assert "Exchange" not in lines[i]
        assert "payload" not in lines[at][lines[at].index("ReadSchema") :]


def test_a_state_is_found_again(spark, state, tmp_path):
    state.refresh(spark.createDataFrame([(1, "a", "one")], ROW), "k", "h", compute)
    again = keyed_state(spark, f"state_{uuid.uuid4().hex}", str(tmp_path / "state"), key="int", buckets=4)
    assert rows(again.current()) == [(1, "a", "ONE")]
    assert rows(again.refresh(spark.createDataFrame([], ROW), "k", "h", compute)) == []
    again.drop()
