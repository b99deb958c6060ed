import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from songloom.session import ROCKSDB_PROVIDER, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__streaming__stateStore__providerClass=ROCKSDB_PROVIDER,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="songloom-cp-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column over literal inputs: ``value(fn, 'a', 'b')``."""
    from pyspark.sql import functions as F

    def run(fn, *args, types=None):
        names = [f"c{i}" for i in range(len(args))]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(args)))
        df = spark.createDataFrame([tuple(args)], schema)
        return df.select(fn(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run
