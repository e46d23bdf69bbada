import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crm_world import (  # noqa: E402
    ACCOUNT_ROWS,
    ACCOUNTS,
    CONTACT_ROWS,
    CONTACTS,
    LEAD_ROWS,
    LEADS,
    MEMBER_ROWS,
    MEMBERS,
    REFERENCE,
)

from callrank.config import JobConfig  # noqa: E402
from callrank.sources.crm import CrmTables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("callrank-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tables(spark):
    return CrmTables(
        spark.createDataFrame(ACCOUNT_ROWS, ACCOUNTS),
        spark.createDataFrame(LEAD_ROWS, LEADS),
        spark.createDataFrame(CONTACT_ROWS, CONTACTS),
        spark.createDataFrame(MEMBER_ROWS, MEMBERS),
    )


@pytest.fixture(scope="session")
def config():
    return JobConfig(reference_date=REFERENCE)


@pytest.fixture(scope="session")
def ranked(tables, config):
    from callrank.plans.job import ReadinessJob

    return ReadinessJob(config).ranked(tables).cache()
