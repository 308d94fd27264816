"""The frame sink: round trips, failed and repeated attempts, number of files."""

import os

import pyarrow as pa
import pytest

from checks.fixtures import fixture
from promptloom.operators import logs
from promptloom.sources import frames as S


def lines_of(df):
    return sorted(tuple(r) for r in df.selectExpr("CAST(run_id AS STRING)", "CAST(seq AS BIGINT)", "line").collect())


def test_round_trip_in_few_files(spark, sf_dir, tmp_path):
    table = fixture(spark, sf_dir, "frames")
    path = str(tmp_path / "out")
    S.write_frame_files(table, path, files=3)
    assert lines_of(S.read_frame_files(spark, path)) == lines_of(table)
    assert len(S.committed_files(path)) <= 3 < table.select("run_id").distinct().count()
    run = table.first().run_id
    one = S.read_frame_files(spark, path, run)
    assert lines_of(one) == lines_of(table.where(f"run_id = {run}"))
    # a run's lines stand in its order, over the files too
    assert [r.text for r in logs.run_text(one.where("line LIKE '0:%'")).collect()] == [
        r.text for r in logs.run_text(table.where(f"run_id = {run}")).collect()
    ]


def test_append_overwrite_and_uri(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "0:\"x\""), ("a", 0, "two\nlines"), ("é", 5, None)], "run_id string, seq bigint, line string")
    path = f"file://{tmp_path}/out"
    S.write_frame_files(first, path)
    expected = [("a", 0, "two lines"), ("a", 1, "0:\"x\""), ("é", 5, "")]
    assert lines_of(S.read_frame_files(spark, path)) == expected
    S.write_frame_files(first.where("seq = 1"), path)
    assert lines_of(S.read_frame_files(spark, path)) == sorted([*expected, ("a", 1, "0:\"x\"")])
    S.write_frame_files(first.where("seq = 5"), path, mode="overwrite")
    assert lines_of(S.read_frame_files(spark, path)) == expected[2:]
    S.write_frame_files(first.limit(0), path, mode="overwrite")
    assert S.read_frame_files(spark, path).count() == 0


def test_a_hot_run_is_spread(spark, tmp_path):
    many = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN 'hot' ELSE concat('r', id % 50) END AS run_id", "id AS seq", "concat('line ', id) AS line")
    path = str(tmp_path / "out")
    S.write_frame_files(many, path, files=6)
    assert lines_of(S.read_frame_files(spark, path, "hot")) == lines_of(many.where("run_id = 'hot'"))
    sizes = [sum(b.num_rows for b in S._Reader(path, "hot").read(S._File(f))) for f in S.committed_files(path)]
    assert sum(n > 0 for n in sizes) > 2 and max(sizes) < 12_000


def test_failed_and_repeated_attempts_count_once(spark, tmp_path):
    path = str(tmp_path / "out")
    batch = pa.RecordBatch.from_pydict({"run_id": ["a", "a", "b"], "seq": [0, 1, 0], "line": ["x", "y", "z"]})

    def breaks():
        yield batch
        raise RuntimeError("executor lost")

    writer = S._Writer(path, False)
    with pytest.raises(RuntimeError):
        writer.write(breaks())
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert S.read_frame_files(spark, path).count() == 0  # nothing counts before the commit
    writer.commit([again, None, writer.write(iter([]))])
    assert lines_of(S.read_frame_files(spark, path)) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    assert first.file not in S.committed_files(path)
    # a write that is given up removes its files and changes nothing
    other = S._Writer(path, True)
    lost = other.write(iter([batch]))
    other.abort([lost, None])
    assert not os.path.exists(os.path.join(path, lost.file)) and S.read_frame_files(spark, path).count() == 3
