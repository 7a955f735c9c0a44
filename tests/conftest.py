import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from convoscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("convoscope-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
