import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bibflux.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
