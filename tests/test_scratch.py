"""The shared folder: its scheme, its absence on a cluster, and what is deleted when."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from brindle import scratch


def test_paths_without_a_scheme_get_one(spark, tmp_path):
    assert scratch.qualified(spark, f"{tmp_path}/a/") == f"file://{tmp_path}/a"
    assert scratch.qualified(spark, f"file:{tmp_path}/a") == scratch.qualified(spark, f"file://{tmp_path}/a") == f"file://{tmp_path}/a"
    assert scratch.shared_root(spark).startswith("file:///")


def test_a_default_file_system_other_than_the_local_one_counts(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert scratch.qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_no_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())


def test_passing_tables_go(spark):
    root = Path(scratch.run_folder(spark).removeprefix("file://"))
    last = scratch.shared_path(spark, "last")
    with scratch.passing(spark):
        a = scratch.stored(spark.range(3), "a")
        with scratch.passing(spark):
            assert scratch.stored(spark.range(4), "b").count() == 4
        assert a.count() == 3 and not list(root.glob("b-*")) and list(root.glob("a-*"))
        a.write.parquet(last)
    assert not list(root.glob("a-*")) and spark.read.parquet(last).count() == 3


def test_nothing_is_left_behind(tmp_path):
    code = (
        "from brindle.session import build_session; from brindle.scratch import stored\n"
        "s = build_session('local[1]', 1, spark__ui__enabled='false', spark__checkpoint__dir=r'%s')\n"
        "assert stored(s.range(3), 'x').count() == 3; s.stop()" % tmp_path
    )
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120, capture_output=True)
    assert not [p for p in tmp_path.rglob("*") if p.name.startswith("brindle-")]
