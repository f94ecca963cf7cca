"""What a vendor's payload holds of a posting comes back for every row of the table, whatever its id."""

import pytest

from postloom.plans import bindings, nested
from postloom.sources import payloads


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    rows = [(i, f"Title {i}\nbody <b>{i}</b>", "en", f"s{i % 2}", 20) for i in range(420)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def both(spark, sf, name):
    """Each posting as the table has it, and as the query gives it."""
    table = {r["source_id"]: r for r in bindings.post(spark, sf).collect()}
    got = {r["source_id"]: r for r in nested.QUERIES[name](spark, sf).collect()}
    assert len(table) == 420 and got.keys() == table.keys()
    return [(table[k], got[k]) for k in table]


def test_google_keeps_every_date_and_department(spark, sf):
    for t, g in both(spark, sf, "a09_google"):
        assert (g["posted"], g["department"]) == (str(t["posted_at"].date()), t["department"])


def test_google_dates_with_a_time_and_absent_departments_are_none(spark):
    payload = '{"jobs": [{"id": "1", "date": "2024-01-02T03:04:05Z"}, {"id": "2", "date": "2024-01-02", "department": "d"}]}'
    out = payloads.normalize_google(spark.createDataFrame([("c", "b", payload)], "company string, board_id string, payload string"))
    assert {r["source_id"]: (r["department"], r["posted_at"] is None) for r in out.collect()} == {"1": (None, True), "2": ("d", False)}


def test_smartrecruiters_keeps_every_date_and_country(spark, sf):
    for t, g in both(spark, sf, "a06_smartrecruiters"):
        assert (g["posted"], g["location"]) == (str(t["posted_at"].date()), "Remote" if t["remote"] else t["location"])
