import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomspan.session import local_session, shipped


@pytest.fixture(scope="session")
def spark():
    return shipped(local_session(4, "4g", 4))
