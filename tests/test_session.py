"""The shared folder, and queries that a broken dependency must not hide."""

import os
import subprocess
import sys

import pytest

from loomline import session


class Named:
    """A session whose settings are given."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.folder = master, folder

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder


def test_a_cluster_without_a_shared_folder_is_refused():
    assert session.shared_folder(Named("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert session.shared_folder(Named("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Named("spark://host:7077"))


def test_scratch_folders_are_discarded(spark):
    path = session.scratch(spark, "test")
    spark.range(3).write.parquet(f"{path}/table")
    assert os.path.exists(f"{path}/table/_SUCCESS")
    session.discard(spark, path)
    assert not os.path.exists(path)


def test_only_a_subpackage_that_is_gone_is_passed_over(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "corpus_pipeline.py").write_text("import a_dependency_that_is_broken\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True)
    assert "a_dependency_that_is_broken" in run.stderr
