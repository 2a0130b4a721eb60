import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larder.session import get_session

    import tempfile

    warehouse = tempfile.mkdtemp(prefix="larder-warehouse-")
    s = get_session("local[4]", app_name="larder-tests", shuffle_partitions=4,
                    extra_conf={"spark.sql.warehouse.dir": warehouse})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
