import random

from pyspark.sql import functions as F

from brackenfold.operators import change_feed as cf

SCHEMA = "k bigint, lsn bigint, op string, payload string"


def interpret(rows, base=()):
    live = {k: s for k, s in base}
    for k, lsn, op, _ in sorted({(k, s, o.strip().lower()[:1], None) for k, s, o, _ in rows if k is not None}, key=lambda r: r[1]):
        if op == "i" and k not in live or op == "u" and k in live:
            live[k] = lsn
        elif op == "d":
            live.pop(k, None)
    return live


def random_feed(seed, n=400, keys=12):
    r = random.Random(seed)
    rows = [(r.choice([0] * 6 + list(range(keys))), lsn, r.choice(["Insert", "u", " DELETE", "Update", "insert", "Checkpoint"]), f"v{lsn}") for lsn in range(n)]
    rows = [x for x in rows if x[2] != "Checkpoint"] + r.sample(rows, 60)
    r.shuffle(rows)
    return [x for x in rows if x[2] != "Checkpoint"]


def test_effective_lsn_against_interpreter(spark):
    for seed in range(4):
        rows = random_feed(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for hot in (10, 1_000_000):
            got = {r["k"]: r["lsn"] for r in cf.effective_lsn(df, "k", "lsn", "op", hot_rows=hot).collect()}
            assert got == interpret(rows)


def test_base_rows_count_as_live(spark):
    rows = [(1, 10, "I", "a"), (2, 11, "U", "b"), (3, 12, "D", None), (4, 13, "U", "x")]
    base = spark.createDataFrame([(1, 0, "p"), (2, 0, "q"), (3, 0, "r")], "k bigint, lsn bigint, payload string")
    got = {r["k"]: (r["lsn"], r["payload"]) for r in cf.current_state(spark.createDataFrame(rows, SCHEMA), "k", "lsn", "op", ["payload"], base).collect()}
    assert got == {1: (0, "p"), 2: (11, "b")}


def test_merged_in_parts_of_any_order(spark):
    for seed in (3,):
        rows = random_feed(seed, 240, 8)
        r = random.Random(seed + 100)
        parts = [[] for _ in range(3)]
        for x in rows:
            for part in r.sample(parts, r.choice([1, 1, 2])):
                part.append(x)
        state = None
        for part in parts:
            merged = cf.merged_state(spark.createDataFrame(part, SCHEMA), "k", "lsn", "op", ["payload"], state, r.choice([10, 1_000_000]))
            state = spark.createDataFrame(merged.collect(), "k bigint, lsn bigint, op string, payload string")
        got = {x["k"]: (x["lsn"], x["payload"]) for x in cf.live_state(state, "k", "lsn", ["payload"]).collect()}
        assert got == {k: (s, f"v{s}") for k, s in interpret(rows).items()}
        assert {x["k"]: x["lsn"] for x in cf.effective_lsn(spark.createDataFrame([], SCHEMA), "k", "lsn", "op", state=state).collect()} == interpret(rows)


def test_a_late_insert_stays_dead(spark):
    part = lambda rows: spark.createDataFrame(rows, SCHEMA)
    state = cf.merged_state(part([(1, 1, "I", "a"), (1, 10, "D", None)]), "k", "lsn", "op", ["payload"])
    assert [(r["lsn"], r["op"]) for r in state.collect()] == [(10, "D")]
    state = cf.merged_state(part([(1, 7, "I", "b"), (1, 8, "U", "c")]), "k", "lsn", "op", ["payload"], state)
    assert cf.live_state(state, "k", "lsn", ["payload"]).count() == 0
    state = cf.merged_state(part([(1, 12, "I", "d"), (1, 20, "I", "e"), (1, 14, "U", "f")]), "k", "lsn", "op", ["payload"], state)
    assert [tuple(r) for r in cf.live_state(state, "k", "lsn", ["payload"]).collect()] == [(1, 14, "f")]
    # a delete between two inserts that comes late lets the second one count
    state = cf.merged_state(part([(1, 16, "D", None)]), "k", "lsn", "op", ["payload"], state)
    assert [tuple(r) for r in cf.live_state(state, "k", "lsn", ["payload"]).collect()] == [(1, 20, "e")]


def test_copies_may_lack_payload(spark):
    rows = [(1, 5, "Insert", None), (1, 5, "I", "full"), (1, 5, "1", None)]
    assert [tuple(r) for r in cf.current_state(spark.createDataFrame(rows, SCHEMA), "k", "lsn", "op", ["payload"]).collect()] == [(1, 5, "full")]


def test_nulls_and_empty(spark):
    rows = [(None, 1, "I", "a"), (1, None, "I", "b"), (1, 2, None, "c"), (1, 3, "what", "d")]
    assert cf.effective_lsn(spark.createDataFrame(rows, SCHEMA), "k", "lsn", "op").count() == 0
    assert cf.effective_lsn(spark.createDataFrame([], SCHEMA), "k", "lsn", "op").count() == 0
    assert cf.latest_state(spark.createDataFrame([], SCHEMA), "k", "lsn", "op", ["payload"]).count() == 0


def test_operation_names(spark):
    names = ["Insert", " i", "1", "DELETE\t", "d", "2", "Update ", "U", "3", "checkpoint", "4", "x", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "o string").select(cf.operation(F.col("o"))).collect()]
    assert got == ["I"] * 3 + ["D"] * 3 + ["U"] * 3 + ["C"] * 2 + [None, None]


def test_latest_state_in_any_order_of_parts(spark):
    rows = [(1, 1, "I", "a"), (1, 3, "D", None), (1, 2, "U", "b"), (2, 4, "I", "c"), (2, 4, "I", "c")]
    whole = set(map(tuple, cf.latest_state(spark.createDataFrame(rows, SCHEMA), "k", "lsn", "op", ["payload"]).collect()))
    for cut in range(1, 5):
        late = cf.latest_state(spark.createDataFrame(rows[cut:], SCHEMA), "k", "lsn", "op", ["payload"])
        both = cf.latest_state(spark.createDataFrame(rows[:cut], SCHEMA), "k", "lsn", "op", ["payload"], late)
        assert set(map(tuple, both.collect())) == whole
    assert whole == {(1, 3, True, None), (2, 4, False, "c")}


def test_terminal_state(spark):
    rows = [(1, 1, "I", "a"), (1, 2, "D", None), (1, 3, "U", "b"), (2, 4, "I", "c"), (2, 6, "U", "d"), (2, 5, "U", "e")]
    got = {r["k"]: (r["lsn"], r["deleted"], r["payload"]) for r in cf.terminal_state(spark.createDataFrame(rows, SCHEMA), "k", "lsn", "op", ["payload"]).collect()}
    assert got == {1: (3, True, None), 2: (6, False, "d")}


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "I", "a", 7, 8)], SCHEMA + ", d int, i int")
    assert cf.current_state(df, "k", "lsn", "op", ["payload", "d"]).collect()[0].asDict() == {"k": 1, "lsn": 1, "payload": "a", "d": 7}
