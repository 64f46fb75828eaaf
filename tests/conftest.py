import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestrata.session import get_session
from lodestrata.shipping import ship


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    ship(session)
    return session
