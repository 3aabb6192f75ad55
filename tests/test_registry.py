"""Every registered query of the audit engine against its SQL, at the smallest scale."""

import pytest
from paths import DATA

from lodestone.plans import registry, registry_more, registry_rest  # noqa: F401 (they register their queries)

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, same_as_sql, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        same_as_sql(df, registry.ORACLES[name], SMALL)
    else:
        assert df.count() > 0


def test_entry_without_the_optional_subpackage():
    """The entry module imports and lists the base queries, whether or not the subpackage is there."""
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
