"""The registered queries of the subpackage against their SQL; every query on the small tables."""

import pytest

from rillstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE[name])


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()
