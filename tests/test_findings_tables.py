"""Tables of four methods: one pass over the texts ranks with all of them."""

import pytest

from spoorline.operators import execution
from spoorline.plans import reports
from test_findings import against_sql, folder  # noqa: F401


@pytest.mark.parametrize("name", ["path_table", "execution_counts"])
def test_other_tables_equal_sql(spark, folder, name):  # noqa: F811
    got, want = against_sql(spark, folder, name)
    assert got == want and got


def test_rankings_are_written_once_without_texts(spark, folder, monkeypatch):  # noqa: F811
    seen, kept = [], execution.kept
    monkeypatch.setattr(execution, "kept", lambda df: seen.append(df.columns) or kept(df))
    reports._judged(spark, folder)
    assert seen == [["task_id", *reports.METHODS, *reports.BESIDE]]
