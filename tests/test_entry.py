import __spark_entry__


def test_every_oracle_has_a_query():
    every = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(every) and len(every) >= 40


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == 200 and "overall_status" in rows.columns
