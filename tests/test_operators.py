"""Identity, payloads, catalog, tracking and grounding on literal rows."""

from pyspark.sql import functions as F

from postloom.operators import aggregates, catalog, coverage, filters, joins, tracking
from postloom.sources import payloads, tables

POST = "company string, source_id string, scraped_at string, n int"


def test_dedup_identities(spark):
    rows = [("Stripe", "1", "1", 1), ("stripe", "1", "2", 2), ("STRIPE", "1", "3", 3), ("Other", "1", "1", 4), ("x", "", "1", 5), ("x", None, "1", 6)]
    df = joins.with_key(filters.valid_identity(spark.createDataFrame(rows, POST)))
    new = joins.only_new(df, spark.createDataFrame([], "key string"))
    assert sorted(r.n for r in new.collect()) == [1, 4]
    assert joins.only_new(df, new.select("key")).count() == 0


def test_extractor_answers(spark):
    fence = '```json\n{"jobs": [{"title": "a", "url": "/a"}]}\n```'
    rows = [(1, fence), (2, '[{"title": "b", "url": "/b"}]'), (3, '{"jobs": []}'), (4, ""), (5, "no object here"), (6, '{"jobs": ["x", {"title": "c", "remote": true}]}'), (7, None)]
    out = payloads.parse_extracted(spark.createDataFrame(rows, "page int, raw string"), "raw").collect()
    assert sorted((r.page, r.title, r.remote) for r in out) == [(1, "a", False), (2, "b", False), (6, "c", True)]


def test_row_validity(spark):
    cols = "title string, url string, location string, department string, posted_at string, description_text string, remote boolean, company string, base_url string"
    rows = [("t", "", None, None, None, "", False, "c", "https://x.com/"), (" ", "/a", None, None, None, "", False, "c", "https://x.com/"), ("t", "/a", "anywhere", None, None, "no visa sponsorship", False, "c", "https://x.com/")]
    (r,) = filters.normalize_extracted(spark.createDataFrame(rows, cols)).collect()
    assert (r.url, r.source, r.remote, r.no_sponsorship_phrase) == ("https://x.com/a", "html", True, True)


def test_needs_js(spark):
    pages = ['<noscript>Please enable JavaScript</noscript>', "<p>plain</p>", '<div data-reactroot><a href="x">y</a></div>']
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, h string")
    assert [r.x for r in df.orderBy("i").select(filters.needs_js(F.col("h")).alias("x")).collect()] == [True, False, True]


def test_sanity_cap(spark):
    pages = spark.createDataFrame([(1, "<a >" * 5), (2, "<a >" * 5)], "page_id int, html string")
    rows = spark.range(999).select(F.lit(1).alias("page_id")).unionByName(spark.range(10).select(F.lit(2).alias("page_id")))
    assert filters.sanity_cap(rows, pages).groupBy("page_id").count().collect() == [(2, 10)]


def test_unreadable_payload_gives_no_rows(spark):
    raw = spark.createDataFrame([("c", "b", "{oops"), ("c", "b", None)], "company string, board_id string, payload string")
    assert payloads.normalize_greenhouse(raw).count() == 0


def test_detection_skips_reserved_slug(spark):
    html = '<iframe src="https://boards.greenhouse.io/embed"></iframe><a href="https://jobs.lever.co/acme">x</a>'
    r = spark.range(1).select(catalog.detect_ats(F.lit(html), F.lit("")).alias("d")).first().d
    assert (r.ats, r.board_id) == ("lever", "acme")


def test_status_and_upsert(spark):
    seen = joins.with_key(spark.createDataFrame([("a", "1"), ("b", "2")], "company string, source_id string")).withColumns({"status": F.lit("NEW"), "status_updated_at": F.lit(None).cast("timestamp")})
    sid = {r.company: r.key[:16] for r in seen.collect()}
    calls = spark.createDataFrame([(f"applied:{sid['a']}", "2024-01-01"), (f"offer:{sid['a']}", "2024-01-02"), ("offer:feed", "2024-01-03"), (f"what:{sid['b']}", "2024-01-03")], "data string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = {r.company: r.status for r in tracking.apply_status(seen, tracking.parse_callbacks(calls)).collect()}
    assert out == {"a": "OFFER", "b": "NEW"}
    old = spark.createDataFrame([("k", "APPLIED", "x")], "dedup_id string, status string, t string")
    new = spark.createDataFrame([("k", "NEW", "y"), ("l", "NEW", "z")], "dedup_id string, status string, t string")
    assert sorted(tracking.upsert(old, new).collect()) == [("k", "NEW", "y"), ("l", "NEW", "z")]
    assert sorted(tracking.upsert(old, new, preserve=("status",)).collect()) == [("k", "APPLIED", "y"), ("l", "NEW", "z")]


def test_grounding_names_unknown_employer(spark):
    bullets = spark.createDataFrame([(1, 1, 1, "b")], "doc int, role_index int, bullet_index int, bullet string")
    rewrites = spark.createDataFrame([(1, 1, 1, "Led work at Google")], "doc int, role_index int, bullet_index int, rewritten string")
    employers = spark.createDataFrame([(1, "Acme")], "doc int, employer string")
    (w,) = coverage.grounding_warnings(rewrites, bullets, employers).collect()
    assert w.employer == "Google"


def test_fetch_health(spark):
    rows = [("c", i, ok) for i, ok in enumerate([False, False, False, True, False])]
    df = spark.createDataFrame(rows, "company string, event_id int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    got = [(r.streak, r.state, r.state_before) for r in aggregates.fetch_health(df).orderBy("event_id").collect()]
    assert got == [(1, "closed", "closed"), (2, "closed", "closed"), (3, "open", "closed"), (0, "closed", "half_open"), (1, "closed", "closed")]


def test_topic_drops_bad_messages(spark):
    df = spark.createDataFrame([('{"a": "1"}',), ("{oops",), ('{"a": "' + "x" * 600_000 + '"}',)], "value string")
    assert tables.topic_rows(df, "a string").collect() == [("1",)]


def test_too_many_policies_fail(spark):
    import pytest

    with pytest.raises(ValueError):
        joins.small(spark.range(5), most=3)


def test_release_deletes_what_jobs_left(spark, tmp_path):
    from postloom.streaming import jobs

    jobs.release(spark)
    path = jobs.shared_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    jobs.release(spark)
    jobs.release(spark)
    assert not (tmp_path.parent / path).exists()


def test_seen_table_is_compacted(spark, monkeypatch):
    """Many batches: a key counts once, whatever was written anew in between; a repeated batch changes nothing."""
    from postloom.streaming import jobs

    monkeypatch.setattr(jobs, "COMPACT", 3)
    out = jobs.shared_dir(spark, "seen")
    write = jobs.dedup_batch(f"{out}/seen", f"{out}/new")
    batch = lambda b: spark.createDataFrame([(f"{k:04x}", str(b), f"{k:04x}") for k in range(7 * b, 7 * b + 14)], "key string, scraped_at string, source_id string")
    for b in (0, 1, 2, 2, 3, 4, 4, 5):
        write(batch(b), b)
    new = spark.read.parquet(f"{out}/new")
    assert new.count() == new.select("key").distinct().count() == 7 * 5 + 14
    assert {r.batch: r["count"] for r in new.groupBy("batch").count().collect()} == {0: 14, 1: 7, 2: 7, 3: 7, 4: 7, 5: 7}
    seen = spark.read.parquet(f"{out}/seen")
    assert seen.count() == seen.select("key").distinct().count() == 49


def test_status_and_upsert_batches(spark):
    from postloom.streaming import jobs

    out = jobs.shared_dir(spark, "keyed")
    rows = spark.createDataFrame([(f"{k:02x}" * 32, "NEW", None) for k in range(40)], "key string, status string, status_updated_at timestamp")
    jobs.keyed_table(rows, f"{out}/t")
    calls = lambda *x: spark.createDataFrame([(f"{a}:{f'{k:02x}' * 8}", "2024-01-01") for a, k in x], "data string, ts string").withColumn("ts", F.to_timestamp("ts"))
    write = jobs.status_batch(f"{out}/t", rows.schema)
    for n, b in enumerate([calls(("applied", 3), ("nothing", 4)), calls(("offer", 3), ("skip", 5), ("offer", 99)), calls(("offer", 3), ("skip", 5))]):
        write(b, n)
    got = {r.key[:2]: r.status for r in jobs.read_keyed(spark, f"{out}/t", rows.schema).collect()}
    assert len(got) == 40 and {k: v for k, v in got.items() if v != "NEW"} == {"03": "OFFER", "05": "SKIPPED"}
    up = jobs.upsert_batch(f"{out}/t", rows.schema, "key")
    up(spark.createDataFrame([("03" * 32, "NEW", None), ("ffff", "NEW", None)], rows.schema), 0)
    got = {r.key[:2]: r.status for r in jobs.read_keyed(spark, f"{out}/t", rows.schema).collect()}
    assert len(got) == 41 and {k: v for k, v in got.items() if v != "NEW"} == {"05": "SKIPPED"}


def test_vendor_rows_on_awkward_payloads(spark):
    """Blank and absent fields, as vendors send them."""
    raw = lambda payload: spark.createDataFrame([("c", "b", payload)], "company string, board_id string, payload string")
    only = lambda f, payload, **kw: [r.asDict() for r in f(raw(payload), **kw).collect()]
    (r,) = only(payloads.normalize_lever, '[{"id": "1", "text": "", "description": "<p>abc", "additional": "def</p>", "createdAt": 0, "categories": {"location": "Remote"}}]')
    assert (r["description_text"], r["description_html"], r["remote"], r["posted_at"], r["title"]) == ("abcdef", "<p>abcdef</p>", False, None, "")
    place = lambda x: only(payloads.normalize_smartrecruiters, '{"content": [{"id": "1", "name": "n", "location": %s, "releasedDate": "2024-01-02T00:00:00Z"}]}' % x)[0]
    assert [place(x)["location"] for x in ('{"city": "Rome"}', '{"country": "it"}', "{}", '{"city": "Rome", "country": "it"}', '{"city": "Rome", "remote": true}')] == ["Rome,", ", it", ",", "Rome, it", "Remote"]
    assert place("{}")["posted_at"] is None and place("{}")["url"] == "https://jobs.smartrecruiters.com/b/1"
    (r,) = only(payloads.normalize_workday, '{"jobPostings": [{"title": "t", "externalPath": "/job/x", "postedOn": "2024-01-02T03:04:05+01:00", "locationsText": "Remote", "bulletFields": [""]}]}')
    assert (r["url"], r["source_id"], r["description_text"], r["remote"], str(r["posted_at"])) == ("https://b.wd5.myworkdayjobs.com/en-US/b/job/x", "/job/x", "t", False, "2024-01-02 02:04:05")
    rows = only(payloads.normalize_apple, '{"searchResults": [{"positionId": "1", "postingTitle": "T", "transformedPostingTitle": "t-1", "homeOffice": "Oslo", "locations": [{"name": "A"}]}, {"positionId": "2", "locations": [{"name": "A"}, {"name": "B"}], "postingDate": "soon"}]}')
    assert [(r["description_text"], r["url"], r["location"], r["posted_at"]) for r in rows] == [("T. Team: . ", "https://jobs.apple.com/en-us/details/1/t-1", "Oslo", None), (". Team: . ", "https://jobs.apple.com/en-us/details/2/", "A, B", None)]
    (r,) = only(payloads.normalize_google, '{"jobs": [{"id": "7", "title": "t", "locations": ["Remote", "B"], "date": "2024-01-02"}]}')
    assert (r["location"], r["remote"], r["url"], str(r["posted_at"])) == ("Remote, B", False, "https://careers.google.com/jobs/results/7", "2024-01-02 00:00:00")
    (r,) = only(payloads.normalize_meta, '{"data": {"job_search": {"results": [{"id": "7", "title": "t", "locations": ["A", "B"], "teams": []}]}}}')
    assert (r["url"], r["location"], r["department"]) == ("https://www.metacareers.com/jobs/7/", "A, B", "")
    (r,) = only(payloads.normalize_amazon, '{"jobs": [{"id_icims": 7, "title": "t", "category": "x", "team": "y", "normalized_location": "Remote"}]}')
    assert (r["url"], r["department"], r["remote"]) == ("https://www.amazon.jobs", "y", False)
