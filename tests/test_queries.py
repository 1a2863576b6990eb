import pytest
from oracle import compare

from weftline.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, core.QUERIES[name], core.ORACLES[name])


def test_generated_lines_have_their_properties(spark, sf):
    rows = core.generate_lines(spark, sf).collect()
    assert rows == core.generate_lines(spark, sf).collect()
    assert all(1 <= r.number <= 100_000 and r.text.strip() for r in rows)
    assert len({r.text for r in rows}) < len(rows) or len(rows) < 50
