"""Helpers of the test modules (a module of its own: ``conftest`` is a name that every
test folder has)."""

SMALL = "/root/testdata/sf0.001"


def one(spark, col, value, schema="x string"):
    """Evaluate a Column function on one literal value."""
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]
