import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    return TABLES
