import datetime
import os

import pytest
from pyspark.sql import functions as F, types as T

from lodestone.operators.incremental import VersionedTarget, chunk_target, latest_sighting, replay_chunks, replay_runs
from lodestone.operators.manifests import Manifests
from lodestone.streaming.refresh import changes_per_window, refresh_stream

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_hash", T.BinaryType())])
SCANS = "scan_id long, run_id int, path string, modified_at long, file_hash binary, size_bytes long, scanned_at timestamp_ntz, loaded_at timestamp_ntz"


def at(n):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=n)


def scans(spark, rows):
    return spark.createDataFrame([(i, run, path, 0, h and h.encode(), 1, at(t), at(t)) for i, (run, path, h, t) in enumerate(rows)], SCANS)


def target(spark, tmp_path):
    return VersionedTarget(spark, f"file://{tmp_path}/t", SCHEMA, ["path"], "file_hash")


def test_replay_with_failures_returns_and_ties(spark, tmp_path):
    rows = [
        (1, "a", "1", 0), (1, "b", "1", 0), (1, "b", "1", 0), (1, None, "x", 0),
        (2, "a", "2", 10), (2, "b", "1", 10), (2, "c", None, 10),
        (3, "a", "3", 20), (3, "c", "1", 20),  # fails: its rows stay pending
        (4, "a", "3", 30), (4, "c", "1", 30), (4, "b", "9", 29), (4, "b", "1", 31),
        (5, "a", "1", 40),  # an earlier version comes back
    ]
    found = replay_runs(target(spark, tmp_path), scans(spark, rows).where("path is not null"), [(1, "ok"), (2, "ok"), (3, "failed"), (4, "ok"), (5, "running")], "run_id", ["scanned_at", "scan_id"])
    assert sorted((r.run_id, r.path) for r in found.collect()) == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c"), (4, "a"), (4, "c"), (5, "a")]


def test_a_repeated_run_does_nothing_and_a_lost_one_leaves_no_trace(spark, tmp_path):
    t = target(spark, tmp_path)
    seen = latest_sighting(scans(spark, [(1, "a", "1", 0)]), ["path"], "file_hash", ["scanned_at"])
    seen.write.parquet(f"{tmp_path}/t/data/run=1-lost")  # written, never published
    assert t.pending(seen).count() == 1
    t.publish(1, t.pending(seen))
    assert t.pending(seen).count() == 0
    t.publish(1, seen)
    assert t.rows().count() == 1 and t.manifest()["version"] == 1
    with pytest.raises(ValueError, match="other records"):  # late rows under the name of a published run
        t.publish(1, latest_sighting(scans(spark, [(1, "late", "1", 0)]), ["path"], "file_hash", ["scanned_at"]))


def test_two_runs_at_once(spark, tmp_path):
    a, b = target(spark, tmp_path), target(spark, tmp_path)
    seen = latest_sighting(scans(spark, [(1, "a", "1", 0)]), ["path"], "file_hash", ["scanned_at"])
    stale = b.manifest()
    a.publish(1, seen)
    b.manifest = lambda: stale
    with pytest.raises(RuntimeError):
        b.publish(2, seen)
    assert a.rows().count() == 1


def test_no_runs(spark, tmp_path):
    out = replay_runs(target(spark, tmp_path), scans(spark, [(1, "a", "1", 0)]), [], "run_id", ["scanned_at"])
    assert out.count() == 0 and set(out.columns) == {"path", "file_hash", "run_id"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_p2_found_on_empty_tables(spark, tmp_path):
    import __spark_entry__ as entry

    for name in ("index_runs", "file_scans", "chunk_scans", "chunks", "files"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert entry.queries()["p2_found"](spark, str(tmp_path)).count() == 0


def run_rows(spark, run, *rows):
    return latest_sighting(scans(spark, [(run, p, h, run) for p, h in rows]), ["path"], "file_hash", ["scanned_at"])


def test_compact_keeps_state_runs_and_their_rows(spark, tmp_path):
    t = target(spark, tmp_path)
    for run, h in ((1, "1"), (2, "2")):
        t.publish(run, t.pending(run_rows(spark, run, ("a", h), ("b", "1"))))
    before = sorted(t.state().collect())
    t.compact()
    assert sorted(t.state().collect()) == before
    assert sorted(r.path for r in t.rows([1]).collect()) == ["a", "b"] and [r.path for r in t.rows([2]).collect()] == ["a"]
    t.publish(1, run_rows(spark, 1, ("a", "1"), ("b", "1")))  # a rerun after compact adds nothing
    assert t.rows().count() == 3
    t.publish(3, t.pending(run_rows(spark, 3, ("b", "9"))))
    t.compact()
    t.forget()
    assert {r.path: bytes(r.file_hash) for r in t.state().collect()} == {"a": b"2", "b": b"9"}
    t.publish(2, t.pending(run_rows(spark, 2, ("a", "2"))))  # known, though its folder is gone
    assert len(t.manifest()["runs"]) == 3
    with pytest.raises(ValueError, match="dropped"):
        t.rows([1])


def test_a_late_old_run_is_seen(spark, tmp_path):
    t = target(spark, tmp_path)
    t.publish(5, t.pending(run_rows(spark, 5, ("a", "5"))))
    t.publish(3, t.pending(run_rows(spark, 3, ("a", "3"))))
    assert bytes(t.state().first().file_hash) == b"3" and t.pending(run_rows(spark, 3, ("a", "3"))).count() == 0


def test_a_crash_before_and_after_the_manifest(spark, tmp_path):
    t, seen = target(spark, tmp_path), run_rows(spark, 1, ("a", "1"))
    put, t._manifests.put = t._manifests.put, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.publish(1, t.pending(seen))
    assert t.rows().count() == 0 and t.pending(seen).count() == 1
    t._manifests.put = lambda *x: (put(*x), (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.publish(1, t.pending(seen))
    again = target(spark, tmp_path)
    again.publish(1, again.pending(seen))
    assert again.rows().count() == 1


def test_a_number_is_taken_once(spark, tmp_path):
    m = Manifests(spark, f"file://{tmp_path}/m")
    m.put(1, {"x": 1})
    with pytest.raises(RuntimeError, match="first"):
        m.put(1, {"x": 2})
    assert m.last() == {"x": 1} and m.names(m.folder) == ["000000000001.json"]


def test_empty_tables_and_extra_columns(spark, tmp_path):
    t = target(spark, tmp_path)
    assert t.state().count() == 0 and t.pending(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = latest_sighting(scans(spark, [(1, "a", "1", 0)]), ["path"], "file_hash", ["scanned_at"]).withColumn("__path", F.lit(1)).withColumn("_run", F.lit(7))
    assert t.pending(wide).count() == 1


def test_chunks_against_their_target(spark, tmp_path):
    files = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, path string")
    chunks = spark.createDataFrame([(1, b"x"), (1, b"x"), (1, b"y"), (2, None)], "file_id long, content_hash binary")
    seen = spark.createDataFrame(
        [(1, 8, "a", 0, b"x", at(0)), (2, 8, "a", 1, b"z", at(0)), (3, 8, "a", 1, b"y", at(1)), (4, 8, "b", 0, b"x", at(0)), (5, 8, "b", 1, None, at(0)), (6, 8, "new", 0, b"x", at(0)), (7, 9, "b", 5, b"x", at(2)), (8, 9, "b", 6, b"w", at(2))],
        "scan_id long, run_id int, path string, chunk_index int, content_hash binary, scanned_at timestamp_ntz",
    )
    t = chunk_target(spark, f"file://{tmp_path}/c")
    got = replay_chunks(t, seen, chunks, files, [(8, "ok"), (9, "failed")])
    assert sorted((r.run_id, r.path, r.chunk_index) for r in got.collect()) == [(8, "b", 0), (8, "new", 0), (9, "b", 6)]
    assert sorted((r.path, bytes(r.content_hash)) for r in t.rows([8]).collect()) == [("b", b"x"), ("new", b"x")]
    assert replay_chunks(chunk_target(spark, f"file://{tmp_path}/d"), seen.limit(0), chunks.limit(0), files.limit(0), [(8, "ok")]).count() == 0


def test_stream(spark, tmp_path):
    t = target(spark, tmp_path)
    folder = f"{tmp_path}/in"
    scans(spark, [(1, "a", "1", 0), (1, "b", "1", 0)]).write.parquet(folder)
    refresh_stream(spark, folder, t, f"{tmp_path}/check").awaitTermination()
    scans(spark, [(2, "a", "2", 5), (2, "b", "1", 5)]).write.mode("append").parquet(folder)
    refresh_stream(spark, folder, t, f"{tmp_path}/check").awaitTermination()
    assert sorted((r.path, bytes(r.file_hash)) for r in t.rows().collect()) == [("a", b"1"), ("a", b"2"), ("b", b"1")]
    assert changes_per_window(scans(spark, [(1, "a", "1", 0), (1, "b", "1", 0)])).first().n_scans == 2


def test_a_new_checkpoint_and_batch_runs_on_one_target(spark, tmp_path):
    t, folder = target(spark, tmp_path), f"{tmp_path}/in"
    t.publish(0, t.pending(run_rows(spark, 0, ("z", "1"))))  # a batch run with the number of the first epoch
    scans(spark, [(1, "a", "1", 0)]).write.parquet(folder)
    refresh_stream(spark, folder, t, f"{tmp_path}/one").awaitTermination()
    scans(spark, [(2, "b", "1", 5)]).write.mode("append").parquet(folder)
    refresh_stream(spark, folder, t, f"{tmp_path}/two").awaitTermination()  # starts with epoch 0 again
    assert sorted(r.path for r in t.rows().collect()) == ["a", "b", "z"]
