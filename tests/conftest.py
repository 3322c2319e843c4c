import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sievebase.session import local_session

    session = local_session("8", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def files(spark):
    """Make a files table from {path: content}; the repository is ``r`` unless given."""

    def make(contents, repo="r"):
        rows = [(repo, path, text) for path, text in contents.items()]
        return spark.createDataFrame(rows, "repo string, file_path string, content string")

    return make
