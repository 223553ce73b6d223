import json

from lodestrata.functions import redaction as R


def test_nothing_secret_is_left(spark):
    rows = [
        (1, '{"a": {"Token": "x\\"leak", "b": [{"password": {"deep": ["leak"]}}, 5]}, "token2": "stays"}'),
        (2, '{"secret": ["leak", {"x": 1}], "text": "' + "y" * 30 + '"}'),
        (3, '{"token": "leak'),
        (4, None),
        (5, "[" * 5000 + "]" * 5000),
        (6, '"' + "z" * 40 + '"'),
    ]
    got = {r.id: r.line for r in R.redacted(spark.createDataFrame(rows, "k long, j string"), "k", "j", "token|password|secret", 20).collect()}
    assert json.loads(got[1]) == {"a": {"Token": "***", "b": [{"password": "***"}, 5]}, "token2": "stays"}
    assert json.loads(got[2]) == {"secret": "***", "text": "y" * 20 + "..."}
    assert got[3] == '"***"' and got[4] is None and "leak" not in "".join(x or "" for x in got.values()) and json.loads(got[6]) == "z" * 20 + "..."
