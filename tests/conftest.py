import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mails(spark):
    """Frame builder: keyword rows become mails, everything else is blank."""
    from letterwatch.vocab import REQUIRED_COLUMNS

    def build(*rows):
        data = []
        for i, row in enumerate(rows):
            full = {c: None for c in REQUIRED_COLUMNS} | {"mail_id": i} | row
            data.append(tuple([full["mail_id"]] + [full[c] for c in REQUIRED_COLUMNS]))
        schema = "mail_id long, " + ", ".join(f"{c} string" for c in REQUIRED_COLUMNS)
        return spark.createDataFrame(data, schema)
    return build
