import json

import pytest

from feedframe import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """A frame of posts out of Python objects, in order."""

    def make(*posts):
        rows = [("r", n, 0, 0, p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(posts)]
        return spark.createDataFrame(rows, "run_id string, page_seq bigint, payload_idx int, pos int, raw string")

    return make


@pytest.fixture(scope="session")
def logged(spark):
    """A page log out of bodies, in order."""

    def make(*bodies, run="r"):
        rows = [(run, n, None, b if b is None or isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
        return spark.createDataFrame(rows, "run_id string, page_seq bigint, cursor_sent string, body string")

    return make
