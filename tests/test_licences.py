import json

import pytest

from bomloom.functions.licence import expression_tree, parse_expression
from bomloom.functions.version import direction, downgrade_severity

MIT, GPL, APACHE = {"licence": "MIT"}, {"licence": "GPL-2.0-only", "with": "Classpath-exception-2.0"}, {"licence": "Apache-2.0"}


@pytest.mark.parametrize(
    ("text", "tree"),
    [("MIT", MIT), ("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0", {"or": [MIT, {"and": [APACHE, GPL]}]}), ("(MIT or Apache-2.0) AND MIT", {"and": [{"or": [MIT, APACHE]}, MIT]}), ("((MIT))", MIT),
     ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT MIT", None), ("AND MIT", None), ("MIT WITH (MIT)", None), ("NOASSERTION", None), ("NONE", None), ("", None), (None, None)],
)
def test_expressions(text, tree):
    made = parse_expression(text)
    assert (json.loads(made) if made else None) == tree


def test_columns(spark):
    df = spark.createDataFrame([("MIT", "1.2.3", "1.2"), (None, "v2.0", "1.9"), ("MIT AND", "1.0-security", "0.9-x"), ("x", "1.1-fix", "1.0"), ("x", "a", "b"), ("x", "1.0", "1.0")], "e string, was string, now string")
    from pyspark.sql import functions as F

    rows = df.select(expression_tree(F.col("e")).alias("t"), direction(F.col("was"), F.col("now")).alias("d"), downgrade_severity(F.col("was"), F.col("now")).alias("s")).collect()
    assert [(r.t is not None, r.d, r.s) for r in rows] == [(True, "downgrade", "minor"), (False, "downgrade", "major"), (False, "downgrade", "major"), (True, "downgrade", "suspicious"), (True, "upgrade", None), (True, "none", None)]
