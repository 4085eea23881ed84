import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        # Hundreds of queries run in one JVM: it need not remember their plans.
        .config("spark.sql.ui.retainedExecutions", "5").config("spark.ui.retainedJobs", "20").config("spark.ui.retainedStages", "20").config("spark.sql.maxPlanStringLength", "20000")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def forgotten(spark):
    """What a module's queries have cached goes with it."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def small():
    return SMALL
