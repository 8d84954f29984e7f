import re

import pytest

pytest.importorskip("pyspark")
from strataloom.llm import suffix_dedup as sd  # noqa: E402


def test_partitions_follow_the_runs(spark, capsys):
    """a partition holds about one run, so the sorts before the groups don't spill as the input grows."""
    text = "".join(chr(97 + i * i % 26) for i in range(400))
    docs = spark.createDataFrame([(i, text[i:] + str(i)) for i in range(100)], "doc_id long, text string")
    out = sd.remove_repeats(docs, run_bytes=2000)
    out.explain()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\((?:run|dst)#\d+, (\d+)\)", capsys.readouterr().out)]
    assert dealt and min(dealt) >= 10  # the session has 4
    assert out.agg({"n_removed": "sum"}).first()[0] > 0
