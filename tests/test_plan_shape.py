"""Physical-plan checks for scale properties of the flagship index job."""

import re

from conftest import SF001


def test_index_reads_ledger_once_and_prunes_columns(spark):
    from mediacat.fixtures import fixtures
    from mediacat.operators.ledger import table_hasher
    from mediacat.plans.index import _resolved

    fx = fixtures(spark, SF001)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plan as for large inputs
    try:
        # the plan of the resolved rows, before they are landed
        df = _resolved(fx.media_files, fx.ledger, table_hasher(fx.media_files.select("path", "sha256", "sha1")), False)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    ledger_scans = [s for s in schemas if "is_processed" in s]
    assert len(ledger_scans) == 1, schemas
    # only the columns the job needs are read
    assert all("text" not in s and "meta_json" not in s for s in schemas)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
