import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kilnwork.runtime import session

    s = session(4, partitions=4, **{"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.driver.memory": "3g"})
    from kilnwork.runtime import ship

    ship(s)
    yield s
    s.stop()
