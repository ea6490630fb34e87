import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexiprop.session import checkpoint_dir, local_session

    s = local_session(8, shuffle_partitions=8, app="lexiprop-tests")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # sets a local folder only when none is configured
    yield s
    s.stop()
