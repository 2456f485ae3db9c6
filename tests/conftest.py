import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import compare
    session = compare.session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import compare
    return compare.duck(SF)
