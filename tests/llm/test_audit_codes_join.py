"""op11 to op13 against brute force on small tables with awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from postloom.llm import audit, jaccard_join, vector_codes
from tests.llm.test_operators import LOWER, ROWS, brute_components, empty, found, frame, near, rng, words

# ---- divergence audit ----------------------------------------------------------------------------------------------


def brute_audit(rows, least, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t, _, _ in rows]
    docs, count = Counter(), defaultdict(Counter)
    for (_, lang, source), found_ in zip(rows, terms):
        docs.update((lang, t) for t in set(found_))
        count[lang, source].update(found_)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in count if x == lang)
        whole = sum((count[lang, s] for s in sources), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            parts = {"pair": [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, far(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


def audit_rows():
    rows = [(t, "en", f"s{i % 3}") for i, (_, t) in enumerate(ROWS)]
    rows += [(" ".join(words(int(n))), lang, f"s{i % 9}") for i, n in enumerate(rng.integers(1, 60, 60)) for lang in ("de", None)]
    rows += [(None, "en", "silent"), ("", "fr", "a"), (None, "fr", None), ("one two", "fr", "b"), ("ÉÀ x-y Z9z", "de", "s1"), ("tie ties", "de", "s2")] + [("Copy cOpy COPY it's", "de", "hot")] * 40
    return rows


@pytest.mark.parametrize("least,top,side", [(3, 10, None), (10, 2, None), (2, 4, 4)])
def test_audit(spark, monkeypatch, least, top, side):
    if side:  # several tiles of groups and strips of more parts
        monkeypatch.setattr(audit, "SIDE", 16)
        monkeypatch.setattr(audit, "LEVELS", 2)
        monkeypatch.setattr(audit, "STRIP", 40)
    rows = audit_rows() + ([(" ".join(words(9)), "de", f"x{i}") for i in range(40)] if side else [])
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, value int").repartition(3)
    got = audit.op11_audit(docs, least, top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(rows, least, top)


def test_audit_of_nothing(spark):
    docs = empty(spark).selectExpr("text", "lang", "'s' source")
    assert audit.op11_audit(docs).collect() == []
    one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert audit.op11_audit(one).collect() == []


def test_shares_are_exact():
    n, total = np.array([0, 5, 8 * 10**15, 10**13 + 7]), np.array([4, 9, 9 * 10**15 - 1, 3 * 10**15 + 1])
    assert audit.share(n, total).tolist() == [1 + 10**9 * (a + 2) // b for a, b in zip(n.tolist(), total.tolist())]


@pytest.mark.parametrize("seed", range(4))
def test_trees_are_walked_jointly(seed):
    r = np.random.default_rng(seed)
    shape = (int(r.integers(1, audit.SIDE + 1)), audit.SIDE)
    a, b = ((r.random(shape) < r.choice([0.001, 0.02, 0.3])) * r.integers(1, 50, shape) for _ in range(2))
    totals = [x.sum(1) + 2 * audit.SIDE + 7 for x in (a, b)]
    trees = [audit.Tree(*audit.grown(*np.nonzero(x), x[np.nonzero(x)])) if x.any() else audit.Tree(None, None) for x in (a, b)]
    p, q = (audit.share(x, t[:, None]) for x, t in zip((a, b), totals))
    for same, (y, q2, tree, t2) in ((False, (b, q, trees[1], totals[1])), (True, (a, p, trees[0], totals[0]))):
        values, cells = audit.joint(trees[0], tree, totals[0], t2, same)
        pick = r.integers(0, shape[0], (40, 2))
        for i, j in pick.tolist():
            either = (a[i] > 0) | (y[j] > 0)
            want = int(np.where(either, (p[i] - q2[j]) ** 2 // (p[i] + q2[j]), 0).sum())
            assert (values[i, j], cells[i, j]) == ((want, either.sum()) if not same or i < j else (0, 0))


# ---- vector codes --------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) -> {(vec_id, code, error, label_error)}, digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    whole = [[math.floor(4096 * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    part = lambda v, k: v[k * width : (k + 1) * width]
    books = [[part(whole[i], k) for i in order] for k in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda v: [min((dist(part(v, k), e), i) for i, e in enumerate(books[k])) for k in range(parts)]
    for _ in range(rounds):
        sets = defaultdict(list)
        for v in whole:
            for k, (_, e) in enumerate(assign(v)):
                sets[k, e].append(part(v, k))
        books = [[[sum(x) // len(sets[k, e]) for x in zip(*sets[k, e])] if (k, e) in sets else old for e, old in enumerate(books[k])] for k in range(parts)]
    coded = [(r[0], "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), r[2]) for r, a in zip(kept, map(assign, whole))]
    labels = Counter()
    for _, _, error, label in coded:
        labels[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, labels[label]) for i, c, e, label in coded), digest


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    rows = [(int(i), r.normal(size=width).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in r.permutation(n)]
    rows += [(5, rows[0][1], 1), (6, rows[1][1], None), (7, [0.25] * width, None), (None, [-0.5] * width, 2)] + [(1000 + i, [0.125] * width, 1) for i in range(150)]
    rows += [(2000, None, 1), (2001, [math.nan] + [0.0] * (width - 1), 1), (2002, [0.0] * (width - 1) + [math.inf], 1), (2003, [None] * width, 1)]
    return rows


@pytest.mark.parametrize("rows", [vectors(300, 16, 1), vectors(5, 16, 2)[:9], vectors(60, 24, 3), vectors(40, 8, 4) + [(90, [], 1), (91, [1.0], 1), (-3, [0.5] * 13, 0)], [(1, [], 1), (2, None, 1)]], ids=["many", "few", "width", "lengths", "blank"])
def test_vector_codes(spark, rows):
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = vector_codes.op12_vector_codes(df).collect()
    want, digest = brute_codes(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.op12_vector_codes(df).collect() == []
    df = spark.createDataFrame([(1, [3e38] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="63 bits"):
        vector_codes.op12_vector_codes(df).collect()


def test_blocks():
    r = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)[r.permutation(512)]
    path = grid[vector_codes.hilbert(grid, 3)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours
    values, entries = r.integers(-5000, 5000, (1000, 8)), r.integers(-5000, 5000, (16, 8))
    entries[9] = entries[3]  # a tie goes to the lower number
    b = vector_codes.Blocks.of(values)
    listed = b.shortlists(entries)
    codes, errors = b.nearest(entries, listed, np.arange(len(b.counts)))
    dist = ((values[b.order][:, None] - entries[None]) ** 2).sum(2)
    assert (codes.ravel()[:1000] == dist.argmin(1)).all() and (errors.ravel()[:1000] == dist.min(1)).all()
    assert b.sums.sum(0).tolist() == values.sum(0).tolist() and b.counts.sum() == 1000
    tight = vector_codes.Blocks.of(np.repeat(entries[:4], 64, 0)).shortlists(entries[:8])
    assert (tight.sum(1) == 1).all()  # a block of one point has one entry left


# ---- Jaccard join --------------------------------------------------------------------------------------------------


def join_rows():
    """Short texts around each step of the similarity, families, a shared passage in most rows."""
    rows = [t for _, t in ROWS]
    for n in (3, 8, 9, 10, 11, 12, 18, 20, 21, 22, 30, 33, 45):
        base = words(n)
        rows += [" ".join(base), " ".join(base[1:]), " ".join(base[:-1]), " ".join(base[2:]), " ".join([*base, "end"]), " ".join([*base, "two", "ends"]), " ".join(["go", *base]), " ".join([*base[:-1], "other"])]
    family = " ".join(words(120))
    rows += [near(family, e) for e in (1, 1, 1, 1, 2, 2, 2, 3, 3, 4) for _ in range(3)]
    passage = " ".join(words(25))
    rows += [f"{passage} {' '.join(words(int(n)))}" for n in rng.integers(1, 120, 40)]
    return [(i * 3, t) for i, t in zip(rng.permutation(len(rows)).tolist(), rows)]


JOIN_ROWS = join_rows()


@pytest.mark.parametrize("percent,edge", [(90, None), (90, 24), (80, 12)])
def test_jaccard_join(spark, percent, edge):
    s = jaccard_join.Join(percent=percent, boundary=edge)
    got = found(jaccard_join.jaccard_join(frame(spark, JOIN_ROWS), s), "doc_id", "n_shingles", "component_id")
    want = brute_components(JOIN_ROWS, 3, percent)
    assert got == {i: (n, c) for i, (n, c, _) in want.items()}
    assert len({c for _, c, _ in want.values()}) < len(want) - 20


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    """One family whose lists are long, in small blocks."""
    from postloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_BLOCK_ROWS", 5)
    base = " ".join(words(100))
    rows = [(i, near(base, int(e))) for i, e in enumerate(rng.integers(0, 4, 120))]
    got = found(jaccard_join.op13_jaccard_join(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == {i: (n, c) for i, (n, c, _) in brute_components(rows, 3, 90).items()}


def test_jaccard_join_of_null_and_repeated_ids(spark):
    base = words(60)
    rows = [(None, " ".join(base)), (None, " ".join([*base, "x"])), (4, " ".join(["y", *base])), (4, "alone here it is"), (None, "alone  here IT is"), (9, None), (None, "")]
    got = Counter(tuple(r) for r in jaccard_join.op13_jaccard_join(frame(spark, rows)).collect())
    assert got == Counter([(None, 58, 4), (None, 59, 4), (4, 59, 4), (4, 2, 4), (None, 2, 4), (9, 0, 9), (None, 0, None)])
    assert jaccard_join.op13_jaccard_join(empty(spark)).collect() == []


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_bounds_of_the_join(percent):
    for n in range(1, 150):
        fit = [m for m in range(1, 250) if any(100 * o >= percent * (n + m - o) for o in range(min(n, m) + 1))]
        assert fit == list(jaccard_join.sizes_with(n, percent))
        for m in fit:
            o = min(o for o in range(min(n, m) + 1) if 100 * o >= percent * (n + m - o))
            assert o == jaccard_join.overlap(n, m, percent)
            c, d = sorted(jaccard_join.size_class(x, percent) for x in (n, m))
            parts, spare = jaccard_join.segments(c, percent)
            assert d - c <= 1 and n + m - 2 * o < parts - spare


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_list(percent):
    """Sets at the very bound of the similarity, with a blank segment for every token that differs, too."""
    r = np.random.default_rng(8)
    for n in (1, 2, 9, 10, 19, 20, 50, 100, 333, 1000):
        for m in {*list(jaccard_join.sizes_with(n, percent))[:: max(1, n // 20)], n}:
            o = jaccard_join.overlap(n, m, percent)
            for spread in (2**63 - 1, 2**20):  # tokens in all segments, and in few
                tokens = np.array(sorted({int(x) for x in r.integers(0, spread, 3 * (n + m))}))
                pick = r.permutation(tokens)[: n + m - o]
                a, b = np.sort(pick[:n]), np.sort(pick[n - o :])
                assert len(b) == m and len(np.intersect1d(a, b)) == o
                assert len(np.intersect1d(jaccard_join.postings(a, n, percent), jaccard_join.postings(b, m, percent)))
