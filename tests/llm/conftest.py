import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def prepared(spark):
    from logweir.llm.common import tuned

    tuned(spark)
