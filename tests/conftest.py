import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from docframe.session import local

    session = local(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
