import pytest

from veldspar.session import get_spark, ship


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
