import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tally.session import local_session

    s = local_session(cores=8, shuffle_partitions=int(os.environ.get("TALLY_TEST_PARTITIONS", "8")), app="tally-tests")
    if os.environ.get("TALLY_TEST_TZ"):
        s.conf.set("spark.sql.session.timeZone", os.environ["TALLY_TEST_TZ"])
    yield s
    s.stop()
