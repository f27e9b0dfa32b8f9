import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def views_end_with_their_module():
    yield
    session = SparkSession.getActiveSession()
    for found in session.catalog.listTables() if session else []:
        if found.isTemporary:
            session.catalog.dropTempView(found.name)


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def plan(spark, data_dir):
    """The whole mailing over the retail data, each shared stage computed once."""
    from patronage.plans import MailingPlan
    from patronage.sources.retail import retail_warehouse

    return MailingPlan(retail_warehouse(spark, data_dir), stage_mode="table")


@pytest.fixture
def table(spark):
    """Rows as dicts -> a warehouse table with its declared schema."""
    from patronage.sources import SCHEMAS

    def make(name, rows):
        schema = SCHEMAS[name]
        columns = [part.strip().split(" ")[0] for part in split_ddl(schema)]
        unknown = {c for r in rows for c in r} - set(columns)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)

    return make


def split_ddl(schema):
    parts, depth, current = [], 0, ""
    for ch in schema:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


@pytest.fixture
def person():
    """A constituent nothing excludes; override what the case is about."""

    def make(key, **changes):
        row = {
            "constituent_dim_id": key,
            "constituent_id": str(1000 + key),
            "constituent_system_id": key,
            "household_system_id": key,
            "key_indicator": "I",
            "is_deceased": "No",
            "is_inactive": "No",
            "is_a_constituent": "Yes",
            "no_valid_address": "No",
            "send_mail": "Yes",
            "full_name": f"Person {key}",
            "address1": "1 Main Street",
            "city": "Town",
            "state": "OK",
            "post_code": "74074",
            "country": "United States",
        }
        return {**row, **changes}

    return make


@pytest.fixture(autouse=True)
def _no_views_left(request):
    """A test's temporary views do not reach the tests that list tables."""
    yield
    if "spark" in request.fixturenames:
        session = request.getfixturevalue("spark")
        for t in session.catalog.listTables():
            if t.isTemporary:
                session.catalog.dropTempView(t.name)
