import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterlytics.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="meterlytics-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sources(spark):
    from meterlytics.sources.catalog import load_sources
    return load_sources(spark, SF_SMALL)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
