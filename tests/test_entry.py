from __future__ import annotations

import __spark_entry__


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.registry.FLAGSHIP in known
