from pathlib import Path

import pytest

from corrobora.llm import plans

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, str(FOLDER))
    rows = df.collect()
    assert rows and (not name.endswith("_found") or len({tuple(r) for r in rows}) == len(rows))
