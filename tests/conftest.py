import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = os.environ.get("DYADIC_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from dyadic.session import build_session
    s = build_session(4, 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
