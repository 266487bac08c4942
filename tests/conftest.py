import os
import re
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import DATA  # noqa: E402

from storelytics import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session.build(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="storelytics-tests-"),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from storelytics.sources.bound import Tables

    return Tables(spark, DATA)


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a schema text to a DataFrame; timestamps and decimals are given as text."""

    def make(schema, *rows):
        fields = [f.strip().split(" ") for f in re.split(r",(?![^(]*\))", schema)]
        plain = {"timestamp_ntz": "string"}
        given = ",".join(f"{n} {'string' if t.startswith('decimal') else plain.get(t, t)}" for n, t in fields)
        made = spark.createDataFrame(list(rows), given)
        return made.select(*[made[n].cast(t) for n, t in fields])

    return make
