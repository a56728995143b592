import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from dossier.session import local_session, tune

    session = local_session(8)
    tune(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
