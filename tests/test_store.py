import math

import pytest

from brackenfold import schemas as s
from brackenfold.store import VectorTable


@pytest.fixture
def table(spark, tmp_path):
    return lambda dim=2, name="t": VectorTable.open(spark, f"{tmp_path}/{name}", s.Config(dim=dim), clock=lambda: 1.0)


def test_single_row_and_errors(table):
    t = table(3)
    assert t.is_empty() and t.search([1.0, 0.0, 0.0], 3).count() == 0
    assert t.insert([1.0, 2.0, 3.0], b"test") == 0
    assert len(t) == 1 and t.get(0) == [1.0, 2.0, 3.0] and t.get_meta(0) == b"test" and t.get(5) is None and t.is_deleted(5)
    with pytest.raises(s.DimensionMismatch):
        t.insert([1.0, 2.0])
    with pytest.raises(s.NaNDistance):
        t.insert([math.nan, 1.0, 1.0])
    with pytest.raises(s.IdOutOfBounds):
        t.update(7, [1.0, 1.0, 1.0])
    with pytest.raises(s.IdOutOfBounds):
        t.get_meta(7)


def test_update_delete_reopen(table):
    t = table()
    for x in ([1.0, 0.0], [0.0, 0.0], [0.0, 1.0]):
        t.insert(x, b"m")
    t.update(2, [2.0, 3.0], b"updated")
    assert t.delete(0) and not t.delete(0) and not t.delete(9)
    with pytest.raises(s.UpdateDeletedVector):
        t.update(0, [1.0, 1.0])
    for u in (t, table()):
        assert len(u) == 3 and u.live_len() == 2 and u.get(0) is None and u.get(2) == [2.0, 3.0] and u.get_meta(2) == b"updated"
        assert [r["vec_id"] for r in u.search([1.0, 1.0], 5).collect()] == [2]
        assert u.get(1) == [0.0, 0.0]
    t.flush()
    assert table().live_len() == 2 and table().last_written_lsn() == 6
    with pytest.raises(s.ZeroVector):
        t.search([0.0, 0.0], 1)


def test_batches_and_compaction(spark, table):
    t = table(4)
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.5], bytearray(str(i).encode())) for i in range(10)], "o int, embedding array<float>, metadata binary")
    assert t.insert_many(rows, ["o"]) == (0, 10)
    assert not t.compact()
    assert t.delete_many(spark.createDataFrame([(0,), (1,), (2,), (77,)], "vec_id bigint")) == 3
    assert t.deletion_stats()[:2] == (3, 10) and not t.should_compact()
    assert t.delete(3) and t.should_compact() and t.compact()
    assert len(t) == 6 and t.get_meta(0) == b"4" and t.deleted_count() == 0
    assert t.insert([100.0] * 4) == 6
    assert table(4).live_len() == 7
    with pytest.raises(Exception, match="DimensionMismatch"):
        t.insert_many(rows.selectExpr("o", "slice(embedding, 1, 2) embedding", "metadata"), ["o"])
    assert len(table(4)) == 7


def test_conflicts_and_settings(table):
    a, b = table(), table()
    a.insert([1.0, 0.0])
    with pytest.raises(s.CommitConflict):
        b.insert([0.0, 1.0])
    b.refresh()
    assert b.insert([0.0, 1.0]) == 1
    with pytest.raises(s.DimensionMismatch):
        table(3)


def test_source_filter(table):
    t = table()
    for i in range(6):
        t.insert([1.0, i / 10], b'{"source": "%s"}' % (b"a" if i % 2 else b"b") if i else b"not json")
    for mode in ("prefilter", "postfilter"):
        assert [r["vec_id"] for r in t.search_with_source_filter([1.0, 0.0], 2, 0, "a", mode).orderBy("rank").collect()] == [1, 3]


def test_small_parts_are_merged_and_old_ones_vacuumed(spark, table, monkeypatch, tmp_path):
    from brackenfold import store

    monkeypatch.setattr(store, "MERGE_PARTS", 3)
    t = table(name="m")
    for i in range(5):
        t.insert([1.0, float(i)])
    t.delete(1)
    assert len(t.manifest["parts"]) <= 3 and t.live_len() == 4
    t.flush()
    assert t.manifest["parts"] == [] and t.live_len() == 4 and t.is_deleted(1)
    t.update(2, [5.0, 5.0])
    assert t.get(2) == [5.0, 5.0] and t.get(3) == [1.0, 3.0] and t.is_deleted(1) and t.get(1) is None
    t.flush()
    assert len(list((tmp_path / "m" / "versions").glob("[0-9]*.json"))) <= 2
    assert len(list((tmp_path / "m" / "data").iterdir())) <= 3
    assert table(name="m").get(2) == [5.0, 5.0]


def test_reads_after_a_checkpoint_shuffle_nothing(table):
    t = table(name="p")
    t.insert_batch([[1.0, 0.0], [0.0, 1.0]])
    t.flush()
    assert "Exchange" not in t.live()._jdf.queryExecution().executedPlan().toString()


def test_batches_of_values(table):
    t = table(name="b")
    assert t.insert_batch([[1.0, 0.0], [0.0, 1.0]], [b"x", None]) == [0, 1] and t.insert_batch([]) == []
    with pytest.raises(s.DimensionMismatch):
        t.insert_batch([[1.0, 0.0], [1.0]])
    assert t.insert_raw([1.0]) == 2 and len(t) == 3 and t.get_meta(0) == b"x"
    assert [r["vec_id"] for r in t.search([1.0, 0.0], 5).collect()] == [0, 1]


def test_log_rotation_retention_and_recovery(spark, table, tmp_path):
    from brackenfold.sources import wal_segments as w

    config = s.Config(dim=2, log_segment_bytes=200, log_total_bytes=10_000, log_segments=3)
    log = w.SegmentLog(f"{tmp_path}/log", config)
    for i in range(8):
        log.append("I", i, [1.0, float(i)], b"m")
    log.append("D", 3)
    log.append("U", 4, [9.0, 9.0], b"u")
    names = [x["segment"] for x in log.segments()]
    assert len(names) > 2 and names == sorted(names) and not any(x["checkpointed"] for x in log.segments()) and log.retain() == []
    t = table(name="r")
    assert t.recover(log.read(spark)) == 10 and t.recover(log.read(spark)) == 0
    assert len(t) == 8 and t.is_deleted(3) and t.get(4) == [9.0, 9.0] and t.last_written_lsn() == 10
    # a record cut off by a crash is dropped, and the log goes on behind the last good one
    with open(log.paths()[-1], "ab") as f:
        f.write(w.encode(10, 0, "I", 8, [1.0, 1.0], b"")[:-3])
    again = w.SegmentLog(f"{tmp_path}/log", config)
    assert again.next_lsn == 10 and again.append("I", 8, [2.0, 2.0]) == 10
    assert t.recover(again.read(spark)) == 1 and t.get(8) == [2.0, 2.0]
    t.flush()
    again.checkpoint(11)
    assert len(again.segments()) <= 3 and again.segments()[-1]["first_lsn"] == again.next_lsn
    assert w.SegmentLog(f"{tmp_path}/log", config).checkpoint_lsn == 11
    assert t.recover(again.read(spark)) == 0 and t.live_len() == 8
