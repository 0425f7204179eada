import threading
from collections import Counter

import pytest

from cohortwise.sources import logs
from cohortwise.sources.logs import append_batch, compact_log, read_log

ROW = "who string, n long"


def rows(spark, who, numbers):
    return spark.createDataFrame([(who, n) for n in numbers], ROW)


def held(spark, log):
    return Counter(tuple(r) for r in read_log(spark, log, ROW).collect())


def test_an_empty_log_and_equal_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    assert held(spark, log) == {} and compact_log(spark, log, ROW) == 0
    append_batch(rows(spark, "a", [1, 1, 2]), log)
    append_batch(rows(spark, "a", [1]), log)
    assert held(spark, log) == {("a", 1): 3, ("a", 2): 1}  # rows that are said twice are two


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log, failed = str(tmp_path / "log"), []

    def write(k):
        try:
            for n in range(4):
                append_batch(rows(spark, f"w{k}", [n]), log)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    compact_log(spark, log, ROW)
    for t in threads:
        t.join()
    assert not failed
    assert held(spark, log) == {(f"w{k}", n): 1 for k in range(5) for n in range(4)}


def test_retries_add_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    for _ in range(2):
        append_batch(rows(spark, "a", range(5)), log, "first")
    append_batch(rows(spark, "b", range(2)), log, "second")
    want = held(spark, log)
    assert sum(want.values()) == 7
    compact_log(spark, log, ROW)
    append_batch(rows(spark, "a", range(5)).coalesce(1), log, "first")  # its folder is gone, its rows are not
    assert held(spark, log) == want


def test_an_unfinished_batch_does_not_count_and_can_be_written(spark, tmp_path):
    log = str(tmp_path / "log")
    append_batch(rows(spark, "a", [1]), log, "one")
    append_batch(rows(spark, "b", [1, 2]), log, "two")
    (tmp_path / "log" / "batch=two" / "_SUCCESS").unlink()
    assert held(spark, log) == {("a", 1): 1}
    append_batch(rows(spark, "b", [1, 2]), log, "two")
    assert held(spark, log) == {("a", 1): 1, ("b", 1): 1, ("b", 2): 1}


@pytest.mark.parametrize("breaks", [False, True])
def test_compaction_keeps_every_answer(spark, tmp_path, monkeypatch, breaks):
    log = str(tmp_path / "log")
    for k in range(12):
        append_batch(rows(spark, f"w{k}", range(k)), log)
    want = held(spark, log)
    if breaks:  # ends before the old batches are gone
        folders = logs._folders(spark, log)
        monkeypatch.setattr(logs, "_folders", lambda *_: [*folders])
        compacted = logs._read(spark, folders, logs._schema(ROW))
        compacted.write.parquet(f"{log}/batch=compact-half")
        monkeypatch.undo()
        assert held(spark, log) == want
    assert compact_log(spark, log, ROW) == 12 + breaks
    assert held(spark, log) == want
    assert len(logs._folders(spark, log)) == 1
