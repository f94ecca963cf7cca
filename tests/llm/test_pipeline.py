"""The corpus pipeline: every stage against brute force on its own input, and the whole on a small folder."""

import corpus_pipeline
from tests.llm.test_operators import ROWS, brute_components, brute_hits, frame, words


def folder(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    rows += [(1000 + i, " ".join(x + "$$$" for x in words(50)), "en", "s", 1) for i in range(40)]
    rows += [(2000 + i, " ".join(words(50)), "en", "s", 1) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1000 + i, 0, 0) for i in range(40)] + [(2000 + i, 1, 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ROWS[6][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)

    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    assert kept.columns == columns
    after = texts(kept)
    assert not [i for i in after if 1000 <= i < 2000] and all(i in after for i in range(2000, 2080))

    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    plain = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t in before.items():
        best[plain(t)] = min(best.get(plain(t), (1, 0)), (-len(t or ""), i))
    assert sorted(texts(kept)) == sorted(i for _, i in best.values()) and kept.columns == columns

    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(texts(kept)) == sorted(i for i, (_, _, k) in brute_components(list(before.items()), 5, 80).items() if k)

    kept = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert sorted(texts(kept)) == sorted(i for i, w in brute_hits(list(before.items()), [(1, ROWS[6][1])]).items() if not w[-1])


def test_stages_of_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, and unlike texts of one id, are judged each by itself; one row of each group stays."""
    sf = folder(spark, tmp_path)
    a, b, c, d = (" ".join(words(150)) for _ in range(4))
    edited = lambda t, n: t.replace(" ", f" w{n} ", 1)
    bad = "x " + ROWS[6][1]
    kept = lambda stage, rows: sorted(r.text for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf).collect())
    ids = [None, None, None, None, 5, 5, 5, 5, 6, None]
    rows = list(zip(ids, [a, b, a, a, c, d, c, c, a, ""]))
    assert kept(corpus_pipeline.drop_copies, rows) == sorted([a, b, c, d, ""])
    rows = list(zip(ids, [a, b, edited(a, 1), a, c, d, edited(c, 1), c, edited(a, 2), ""]))
    out = kept(corpus_pipeline.drop_near_copies, rows)
    assert len(out) == 5 and {"", b, d, edited(a, 2)} < set(out)  # id 6 is the only one in a's group
    rows = [(None, a), (None, bad), (5, bad), (5, b), (None, c), (5, d), (None, "")]
    assert kept(corpus_pipeline.drop_contaminated, rows) == sorted([a, b, c, d, ""])


def test_run(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path)).collect()
    assert len(corpus_pipeline.STAGES) == 5 and out
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
    assert not {r.doc_id for r in out} & set(range(1000, 1040))
    assert len({r.doc_id for r in out}) < len(ROWS) + 80


def test_runs_do_not_disturb_each_other(spark, tmp_path):
    """A result that is not read yet outlives another run, and stages that are called by themselves."""
    sf = folder(spark, tmp_path)
    once = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.pack(spark, docs, sf)
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    again = corpus_pipeline.run(spark, sf)
    assert kept.count() and packed.count() >= docs.count()
    n = once.count()
    assert n and n == again.count() == once.count()


def test_stages_take_an_empty_table(spark, tmp_path):
    sf = folder(spark, tmp_path)
    docs = frame(spark).selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
