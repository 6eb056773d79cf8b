import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gtdlens.session import local_session, release_written  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    release_written(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
