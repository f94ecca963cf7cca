"""Operators on hot keys and large sides: equal to the plain form, with plans that hold no key's rows in one window."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postloom.operators import aggregates, coverage, joins, scoring


def outcomes(spark, n=600):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randint(0, 400), i, r.random() < 0.3) for i in range(n)]
    rows += [("down", 10 * i, 10_000 + i, False) for i in range(90)] + [("one", 5, 20_000, True), ("tie", 7, 20_001, False), ("tie", 7, 20_002, False)]
    return spark.createDataFrame(rows, "company string, s int, event_id int, ok boolean").withColumn("ts", F.timestamp_seconds("s")).repartition(4), rows


@pytest.mark.parametrize("rows", [7, 50, 1 << 20])
def test_fetch_health_by_slices(spark, rows):
    df, listed = outcomes(spark)
    got = {r.event_id: (r.streak, r.state_before, r.state) for r in aggregates.fetch_health(df, 3, 30, rows=rows).collect()}
    streak, last, want = {}, {}, {}
    for company, s, i, ok in sorted(listed, key=lambda x: (x[1], x[2])):
        before = streak.get(company, 0)
        probed = ("half_open" if s - last[company] > 30 else "open") if before >= 3 else "closed"
        streak[company], last[company] = 0 if ok else before + 1, s
        want[i] = (streak[company], probed, "open" if streak[company] >= 3 else "closed")
    assert got == want


@pytest.mark.parametrize("rows", [5, 60, 1 << 20])
def test_repost_count_by_slices(spark, rows):
    df, _ = outcomes(spark)
    df = df.withColumns({"at": F.timestamp_seconds(F.col("s") * 3600), "title": F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 2)})
    none = df.limit(3).withColumns({"at": F.lit(None).cast("timestamp"), "event_id": -F.col("event_id") - 1})
    got = {r.event_id: r.repost_count for r in scoring.repost_count(df.unionByName(none), 2, "at", rows=rows).collect()}
    w = W.partitionBy("company", "title").orderBy(F.unix_seconds("at")).rangeBetween(-2 * 86_400, -1)
    want = {r.event_id: r.n for r in df.withColumn("n", F.count("*").over(w)).collect()}
    assert got == want | {r.event_id: 0 for r in none.collect()}


def test_no_window_holds_a_whole_log(spark):
    """A key with most rows is in many slices, none much larger than asked for."""
    df, _ = outcomes(spark, 3000)
    sizes = aggregates.time_slices(df, F.col("company"), F.unix_micros("ts"), 100).groupBy("_key", "_slice").count().collect()
    assert max(r["count"] for r in sizes) < 250 and sum(r["count"] > 50 for r in sizes) > 15


def test_aliases_by_runs_of_signs(spark):
    r = random.Random(6)
    word = lambda a, b: "".join(r.choice("abcé") for _ in range(r.randint(a, b)))
    for extra in ([], [("", "blank", 25)]):
        aliases = [(word(1, 5), f"v{i}", i) for i in range(40)] + [("QQ", "large", 1), ("zz", "x", 5), ("zz", "y", 4)] + extra
        names = [None, "", "qq", "xqqx", "zz", "nothing", *(word(0, 8) for _ in range(60))]
        df = spark.createDataFrame([(n,) for n in names], "name string")
        out = joins.alias_lookup(df, spark.createDataFrame(aliases, "alias string, value string, rank int"))
        got = sorted((str(x.name), x.value) for x in out.collect())
        def best(n):
            low = (n or "").lower()
            hits = [(a.lower() != low, k, v) for a, v, k in aliases if a.lower() in low]
            return min(hits)[2] if hits else "default"
        assert got == sorted((str(n), best(n)) for n in names)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_contained_parts_meet_without_a_nested_loop(spark):
    texts = spark.createDataFrame([(i, f"text number {i} of many") for i in range(50)], "id int, text string")
    parts = spark.createDataFrame([("7 of",), ("r 1",), ("xyz",), ("y",), ("",), (None,)], "part string")
    out = joins.containing(texts, parts)
    assert sorted((x.id, x.part) for x in out.collect()) == sorted([(i, p) for i in range(50) for p in ("7 of", "r 1", "xyz", "y") if p in f"text number {i} of many"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert joins.containing(texts, parts.limit(0)).count() == 0


def test_skills_are_grounded_in_the_source(spark):
    skills = spark.createDataFrame([(1, "Spark"), (1, "Go Lang"), (1, ""), (2, "x"), (1, None)], "doc int, skill string")
    sources = spark.createDataFrame([(1, "SPARK and go  lang")], "doc int, text string")
    assert sorted((r.doc, r.skill) for r in coverage.skill_grounding(skills, sources).collect()) == [(1, "Go Lang"), (2, "x")]


# ---- similarity, reports, topics -------------------------------------------------------------------------------------


def test_similarity_in_blocks_equals_the_pairwise_form(spark, monkeypatch):
    from postloom.functions import embed

    monkeypatch.setattr(embed, "BLOCK", 64)
    r = random.Random(7)
    vec = lambda: [r.gauss(0, 1) for _ in range(5)]
    rows = [(i, vec(), "x") for i in range(40)] + [(40, [0.0] * 5, "x"), (41, None, "x"), (42, [1.0], "x")]
    df = spark.createDataFrame(rows, "id int, vector array<double>, pid string").repartition(3)
    profiles = spark.createDataFrame([(i, vec()) for i in range(50)] + [(50, [0.0] * 5), (51, None)], "person int, pv array<double>")
    pairs = scoring.fan_out(df.filter("id < 41"), profiles.filter("person < 51"))
    want = {(x.id, x.person): x.s for x in pairs.select("id", "person", scoring.embedding_score(F.col("vector"), F.col("pv")).alias("s")).collect()}
    got = {(x.id, x.person): x.embedding_score for x in embed.similar(df, "vector", profiles, "person", "pv", ["id", "pid"]).collect()}
    assert {k for k in got if k[0] < 41} == set(want) and all(abs(got[k] - s) < 1e-9 for k, s in want.items())
    assert all(got[42, p] == 0 for p in range(51)) and not [k for k in got if k[0] == 41]
    gated = embed.similar(df, "vector", profiles, "person", "pv", ["id"], 0.7)
    assert {(x.id, x.person) for x in gated.collect()} == {k for k, s in want.items() if s >= 0.7}
    assert embed.similar(df, "vector", profiles.limit(0), "person", "pv", ["id"]).count() == 0
    monkeypatch.setattr(embed, "MAX_PROFILES", 3)
    with pytest.raises(ValueError, match="in parts"):
        embed.similar(df, "vector", profiles, "person", "pv", ["id"])


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    from postloom.functions import embed

    def load():
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100).coalesce(2).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"))
        got = {r.id: list(r.v) for r in df.select("id", embed.embedder(load)("t").alias("v")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: [float(i if i % 9 else 0), 1.0] for i in range(100)} and len(list(tmp_path.iterdir())) <= 2


def test_reports_are_all_there_or_none(spark, tmp_path):
    from postloom.sources import reports, tables

    root = tmp_path / "r"
    df = spark.createDataFrame([(f"id{i}", f"text {i} é") for i in range(20)] + [("empty", None)], "dedup_id string, report string").repartition(4)
    for _ in range(2):
        tables.write_reports(df, str(root))
    assert sorted(p.name for p in root.iterdir()) == sorted(["empty", *(f"id{i}" for i in range(20))])
    assert (root / "id3" / "report.md").read_text() == "text 3 é" and (root / "empty" / "report.md").read_text() == ""
    assert {r.dedup_id: r.report for r in tables.read_reports(spark, str(root)).collect()} == {r.dedup_id: r.report for r in df.collect() if r.report}
    other = tmp_path / "failed"
    late = df.withColumn("report", F.when(F.col("dedup_id") == "id7", F.raise_error(F.lit("lost"))).otherwise(F.col("report")))
    for bad in (late, df.withColumn("dedup_id", F.when(F.col("dedup_id") == "id7", "../up").otherwise(F.col("dedup_id")))):
        with pytest.raises(Exception):
            tables.write_reports(bad, str(other))
        assert not other.exists() or not list(other.iterdir())
    assert reports.qualified(spark, "/some/where") == "file:/some/where" and reports.qualified(spark, "file:///x") == "file:/x"
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.here.link./r", f"file://{tmp_path}")
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://here/")
    try:
        assert reports.qualified(spark, "/r/x") == "viewfs://here/r/x"  # without a scheme: the default file system, never the local disk
    finally:
        conf.set("fs.defaultFS", old)


def test_reports_are_met_by_tasks_only(spark, tmp_path, monkeypatch):
    from postloom.sources import reports, tables

    monkeypatch.setattr(reports, "FILES", 64, raising=False)
    root, old = str(tmp_path / "r"), tmp_path / "r" / "old"
    old.mkdir(parents=True)
    (old / "report.md").write_text("there before")
    df = spark.range(300).select(F.concat(F.lit("id"), "id").alias("dedup_id"), F.concat(F.lit("text "), "id").alias("report")).repartition(3)
    tables.write_reports(df, root)
    tables.write_reports(df.limit(0), root)
    tables.write_reports(spark.createDataFrame([("id7", "new"), ("twice", "a"), ("twice", "a")], df.schema).repartition(3), root)
    (tmp_path / "r" / "id9" / "report.md").unlink()
    got = tables.read_reports(spark, root)
    want = {f"id{i}": f"text {i}" for i in range(300) if i != 9} | {"id7": "new", "twice": "a", "old": "there before"}
    assert sorted((r.dedup_id, r.path, r.report) for r in got.collect()) == sorted((k, f"local:{k}/report.md", v) for k, v in want.items())
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == sorted({*want, "id9"})
    assert len(got.inputFiles()) < 50  # the driver lists no reports


def test_topic_retention_and_clean_up(spark, tmp_path):
    from datetime import date

    from postloom.sources import tables
    from postloom.streaming import jobs

    path, out, old = str(tmp_path / "topic"), jobs.shared_dir(spark, "kept"), str(tmp_path / "old")
    as_of = F.lit("2024-01-31 06:00:00").cast("timestamp")

    def add(*days):
        rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, at string")
        tables.write_topic(rows.withColumn("at", F.to_timestamp("at")), path, "at")

    def read(**kw):
        got = []
        stream = tables.read_topic(spark, path, "id int, at timestamp", as_of, "at", **kw)
        jobs.start(stream, lambda df, n: got.append(sorted(str(r["at"])[:10] for r in df.collect())), f"{out}/checkpoint").awaitTermination()
        return got

    add("2024-01-10", "2024-01-24 05:00:00", "2024-01-24 07:00:00", "2024-01-31")
    assert sum(read(), []) == ["2024-01-24", "2024-01-31"]
    assert read() == []  # a restart repeats nothing
    add("2024-01-30", "2024-01-29", "2024-01-28")
    got = read(files=1, clean=old)
    assert sorted(sum(got, [])) == ["2024-01-28", "2024-01-29", "2024-01-30"] and max(map(len, got)) == 1
    assert tables.expire_topic(spark, path, date(2024, 1, 31)) == ["2024-01-10"]
    assert not (tmp_path / "topic" / "day=2024-01-10").exists()
    add("2024-01-27")
    assert read(clean="delete") == [["2024-01-27"]]
    assert tables.expire_topic(spark, str(tmp_path / "none"), date(2024, 1, 31)) == []


# ---- YAML files ------------------------------------------------------------------------------------------------------


def test_registries_profiles_and_targets_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    from postloom.sources import yaml_files

    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("c/wrapped.yaml", "companies:\n  - {name: A, ats: Greenhouse, board_id: a, tier: 0}\n  - {name: B, ats: nobody, tier: 3, workday_tenant: flat, workday: {tenant: nested}}\n  - just text\n")
    put("c/flat.yaml", "- name: C\n  ats: custom\n  custom: {scraper_module: x.y.mod, params: {a: text, n: 3}}\n")
    put("c/sub/one.yaml", "name: D\nats: workday\nactive: true\ntier: 1\nworkday: {board: W}\nworkday_board: old\ncustom_module: own\ncustom: {scraper_module: p.q}\n")
    put("c/sub/off.yaml", "name: E\nats: lever\n")
    put("c/bad.yaml", "companies: [unclosed\n")
    put("c/number.yaml", "42\n")
    put("c/empty.yaml", "companies:\n")
    got = {r.name: r for r in yaml_files.read_companies(spark, str(tmp_path / "c")).collect()}
    assert set(got) == {"A", "B", "C", "D"}
    assert (got["A"].tier, got["A"].ats, got["B"].ats, got["B"].tier, got["B"].workday_tenant) == (2, "greenhouse", "unknown", 3, "nested")
    assert (got["C"].custom_module, got["C"].custom_params) == ("mod", {"a": "text"})
    assert (got["D"].tier, got["D"].verified, got["D"].workday_board, got["D"].custom_module) == (2, True, "W", "own")
    errors = yaml_files.read_yaml(spark, str(tmp_path / "c"), "companies").filter("error is not null").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in errors) == ["bad.yaml", "number.yaml", "wrapped.yaml"]
    put("t/a.yaml", "targets:\n  - {name: A, url: first, max_pages: 3}\n  - {name: ''}\n  - {name: A, url: last}\n")
    (t,) = yaml_files.read_targets(spark, str(tmp_path / "t")).collect()
    assert (t.name, t.url, t.max_pages) == ("A", "last", None)
    put("p/ann/profile.yaml", "name: Ann\nskills: [a, b]\n")
    put("p/ann/skills.yaml", "skills: [c]\n")
    put("p/bob/profile.yaml", "name: Bob\nskills: [d]\n")
    put("p/cid/profile.yaml", "name: Cid\n")
    got = {r.person_id: r.skills for r in yaml_files.read_profiles(spark, str(tmp_path / "p")).collect()}
    assert got == {"ann": ["c"], "bob": ["d"], "cid": []}
