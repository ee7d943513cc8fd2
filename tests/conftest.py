import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chartloom.session import get_session
    return get_session(8, "chartloom-tests")


@pytest.fixture(scope="session")
def sf():
    return SF
