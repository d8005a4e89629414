"""Graphs kept up to date with files that come, change and go."""

from datetime import datetime

from loomgraph.operators import story
from loomgraph.sources import scripts
from loomgraph.streaming import ingest

JUMP = "label {}:\n    jump {}\n"


def test_changed_and_deleted_files(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda h: datetime(2024, 1, 1, h)
    batches = [
        [("p", "a.rpy", JUMP.format("start", "b"), None, at(1)), ("p", "b.rpy", JUMP.format("b", "start"), False, at(1)), ("p", "c.rpy", JUMP.format("c", "b"), None, at(1)), ("q", "a.rpy", JUMP.format("start", "start"), None, at(1)), (None, "x", "y", None, at(1))],
        [("p", "b.rpy", JUMP.format("b", "d"), None, at(3)), ("p", "b.rpy", "label old:\n", None, at(2)), ("p", "c.rpy", None, True, at(3)), ("p", "d.rpy", "label d:\n    return\n", None, at(3)), ("q", "a.rpy", JUMP.format("start", "start"), None, at(3)), ("r", "gone.rpy", None, True, at(3))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, ingest.CHANGES).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_graphs(spark, source, target, str(tmp_path / "checkpoint"))
    files = [("p", "a.rpy", JUMP.format("start", "b")), ("p", "b.rpy", JUMP.format("b", "d")), ("p", "d.rpy", "label d:\n    return\n"), ("q", "a.rpy", JUMP.format("start", "start"))]
    whole = story.linked(scripts.file_order(spark.createDataFrame([(p, f, f, c) for p, f, c in files], "project_id string, path string, name string, content string")).drop("name"))
    for table, columns in (("nodes", ["project_id", "id", "type", "role", "is_orphan"]), ("edges", ["project_id", "id", "source", "target", "kind"])):
        want = sorted(map(tuple, getattr(whole, table).select(*columns).collect()))
        assert sorted(map(tuple, ingest.latest(spark, target, table).select(*columns).collect())) == want and want
    touched = {(r.project_id, r.epoch) for r in spark.read.parquet(f"{target}/projects").collect()}
    assert touched == {("p", 0), ("q", 0), ("p", 1)}
