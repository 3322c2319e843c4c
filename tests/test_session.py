"""Work folders: one base per process, removed when asked for."""

import os

from sievebase import session


def test_work_folders_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    rows = session.materialize(spark.range(5), "five")
    assert rows.count() == 5
    unused, (used, _) = session.scratch_dir(spark, "unused"), (session._made[0], None)
    assert os.path.isdir(used) and os.path.dirname(used) == os.path.dirname(unused)
    assert session.release_scratch(spark) == 1 and not os.path.exists(used) and session._made == []
