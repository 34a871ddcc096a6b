"""Centroid search, ranked search and fingerprints against brute force, on odd tables too."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import clustering, merkle, ranking
from tests.llm.test_operators import empty, odd  # noqa: F401 - a fixture

# --- 11 centroids


def _round(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("k,d,spread", [(1, 3, 5), (8, 64, 2000), (40, 5, 3), (7, 2, 1), (13, 64, 1)])
def test_threshold_search_equals_brute_force_with_ties(k, d, spread):
    rng = np.random.default_rng(k)
    c, x = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread - 2, spread + 3, (3000, d))
    x[:k] = c
    number, distance = clustering.CentroidLists(c).nearest(x)
    want, far = _round(x, c)
    assert (number == want).all() and (distance == far).all()


def test_search_stops_before_it_has_met_all(monkeypatch):
    c = np.arange(0, 64_000, 1000).repeat(4).reshape(64, 4)
    lists = clustering.CentroidLists(c)
    lists.centroids = CountingRows(lists.centroids)
    number, _ = lists.nearest(np.array([[5, 5, 5, 5], [30_100, 30_100, 30_100, 30_100]]))
    assert number.tolist() == [0, 30] and lists.centroids.rows < 2 * 64


class CountingRows:
    def __init__(self, rows):
        self.all, self.rows, self.shape = rows, 0, rows.shape

    def __getitem__(self, at):
        self.rows += len(at)
        return self.all[at]


def test_extreme_components_do_not_overflow():
    c = np.array([[-clustering.LIMIT] * 64, [clustering.LIMIT] * 64])
    number, distance = clustering.CentroidLists(c).nearest(c[::-1].copy())
    assert number.tolist() == [1, 0] and distance.tolist() == [0, 0]
    assert clustering.CentroidLists(c[:1]).nearest(c[1:])[1][0] == 64 * (2 * clustering.LIMIT) ** 2


def test_rounds_against_brute_force_and_odd_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    good += [good[3], good[3], (None, [0.5] * 64), (301, [1e30] + [0.0] * 63)]
    bad = [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [None] + [0.1] * 63), (405, [float("nan")] + [0.1] * 63), (406, [float("-inf")] + [0.1] * 63)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<float>, id string, cluster int").repartition(3)
    assigned, centroids = clustering.cluster_vectors(df)
    out = clustering.with_inertia(assigned, centroids).collect()

    def whole(x):
        return max(-clustering.LIMIT, min(clustering.LIMIT, math.floor(1024 * float(np.float32(x))))) if abs(x) < 1e6 else clustering.LIMIT

    rows = [(i, [whole(x) for x in v]) for i, v in good]
    x = np.array([v for _, v in rows])
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:8]
    c = np.array([v for _, v in first])
    for _ in range(10):
        n, _ = _round(x, c)
        c = np.array([[sum(int(a) for a in x[n == i][:, j]) // int((n == i).sum()) for j in range(64)] if (n == i).any() else c[i] for i in range(8)])
    n, d = _round(x, c)
    assert (centroids == c).all()
    want = sorted((str(i), int(a), int(b), int(d[n == a].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, b in zip(rows, n, d))
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out) == want


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assigned, centroids = clustering.cluster_vectors(df)
    assert assigned.count() == 3 and len(centroids) == 3
    nothing = clustering.with_inertia(*clustering.cluster_vectors(empty(df)))
    assert nothing.collect() == [] and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- 12 ranked search

TERMS = re.compile(ranking.TERM)
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _ranked(docs, items, k):
    bags = [(i, TERMS.findall(low(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(TERMS.findall(low(t)))
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, terms in queries.items():
        found = []
        for doc, bag in bags:
            m = 50 + 50 * len(bag) * n_docs // max(length, 1)
            score = 0
            for t in terms:
                tf = bag.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(str(item), r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "the", "x1", "Öl", "öl", "ab", "b", "abc", "é", "中文", "Z9"] + [f"w{i}" for i in range(60)]
    text = lambda m: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00", "  "]) for _ in range(rng.randint(0, m)))
    docs = [(i, text(60)) for i in range(n)] + [(3, "the x1 the"), (3, "the x1 the"), (None, "the x1 the"), (n, None), (n + 1, ""), (n + 2, " ,"), (n + 3, "abc " * 20_000)]
    return docs, [(i, text(12)) for i in range(9)] + [(2, "the Öl"), (None, "the abc"), (50, None), (51, ""), (52, "never-seen")]


def _run(spark, docs, items, k):
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, row long, score string").repartition(4)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term long").repartition(2)
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranking.rank_documents(d, i, k).collect()), key=str)


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 50), (3, 1000)])
def test_ranks_by_brute_force(spark, seed, k):
    docs, items = _corpus(seed, 150)
    assert _run(spark, docs, items, k) == _ranked(docs, items, k)


def test_blocks_windows_and_giant_items(spark, monkeypatch):
    docs, items = _corpus(4, 100)
    want = _ranked(docs, items, 7)
    monkeypatch.setattr(ranking, "BLOCK", 40)  # several blocks, and items beyond one
    assert _run(spark, docs, items, 7) == want


def test_scanner_windows(monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW", 16)
    docs, _ = _corpus(6, 80)
    terms = ["a", "the", "öl", "abc", "é", "中文"]
    column = pa.array([t for _, t in docs]).slice(2)
    total, text, term, n = ranking.TermScanner(terms).count(column)
    bags = [TERMS.findall(low(t)) for t in column.to_pylist()]
    assert total.tolist() == [len(b) for b in bags]
    assert dict(zip(zip(text.tolist(), term.tolist()), n.tolist())) == {(i, j): b.count(t) for i, b in enumerate(bags) for j, t in enumerate(terms) if t in b}


def test_best_of_a_task_keeps_ties_by_id(monkeypatch):
    monkeypatch.setattr(ranking, "GATHER", 3)
    best = ranking._Best(1, 2)
    for ids in ([9, 8], [7, None], [1, 5]):
        best.offer(np.full((2, 1), 4), pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0, 1])], ["doc_id", "row"]))
    assert sorted(i for b in best.rows() for i in b.column("doc_id").to_pylist()) == [1, 5]


def test_no_documents_or_items(spark):
    docs, items = _corpus(1, 20)
    assert _run(spark, docs, [(1, None)], 5) == [] and _run(spark, [(1, None)], items, 5) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert ranking.rank_documents(empty(d), d.select(F.col("doc_id").alias("item_id"), "text")).collect() == []


def test_ranks_of_odd_rows(spark, odd):  # noqa: F811
    got = ranking.rank_documents(odd, spark.createDataFrame([(1, "a b c the"), (2, "tie one")], "item_id long, text string"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == _ranked(rows, [(1, "a b c the"), (2, "tie one")], 50)


# --- 13 fingerprints

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def _leaves(text):
    return re.findall(r"[^.!?\n]+[.!?\n]?|[.!?\n]", text)


def _fingerprint(text):
    sections, run = [], []
    for leaf in _leaves(text):
        run.append(sha(leaf))
        if run[-1].endswith("0") or leaf == "\n":
            sections.append(run)
            run = []
    sections += [run] if run else []
    hashes = [sha("".join(s)) for s in sections]
    return sha("".join(hashes)) + "".join(f"/{h[:16]}.{''.join(x[:8] for x in s)}" for h, s in zip(hashes, sections))


def _likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({sha(p)[:8] for p in _leaves(t)} for t in (a, b))
    return len(x & y) / max(len(x | y), 1)


def _expected(docs):
    rows = sorted(((i is not None, i or 0), t or "") for i, t in docs)
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((key[1] if key[0] else None, len(text), sha(edited), _fingerprint(text), _fingerprint(edited), _likeness(text, edited), _likeness(text, after)))
    return sorted(out, key=str)


def _got(df, buckets):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in merkle.fingerprint_documents(df, buckets).collect()), key=str)


def _texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(["One. ", "Two words! ", "A?\n", "\n", "é😀 line\n", "no end ", "x.y "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_fingerprints_by_brute_force(spark, buckets):
    docs = [(3 * i, t) for i, t in enumerate(_texts(60))] + [(500, None), (None, "null id. text")]
    df = spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id long, text string, _bucket int, next_text string").repartition(3)
    assert _got(df, buckets) == _expected(docs)


def test_one_id_on_most_rows_is_cut_into_buckets(spark):
    same = [(5, "same. text\n")] * 400
    docs = [(1, "first. of all"), (9, "last one.")] + same
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert _got(df, 8) == _expected(docs)
    placed = merkle.with_next(df, 8)
    assert placed.count() == len(docs)


def test_empty_single_and_odd_tables(spark, odd):  # noqa: F811
    df = spark.createDataFrame([(1, "a. b.")], "doc_id long, text string")
    assert _got(df, 4) == _expected([(1, "a. b.")])
    assert _got(empty(df), 4) == []
    out = merkle.fingerprint_documents(odd).collect()
    assert len(out) == odd.count()
    by_text = {}
    for r, (fp, n) in ((r, (r.fingerprint, r.n_chars)) for r in out):
        by_text.setdefault(fp, set()).add(n)
    want = {_fingerprint(r.text or "") for r in odd.collect()}
    assert set(by_text) == want and all(len(n) == 1 for n in by_text.values())


def test_differing_branches_locate_an_edit(spark):
    leaves = [f"Sentence number {i}." for i in range(200)]
    edited = leaves[:90] + ["Another one."] + leaves[91:]
    moved = leaves[:50] + ["Inserted."] + leaves[50:]
    df = spark.createDataFrame([("".join(leaves), "".join(edited), "".join(moved))], "a string, b string, c string")
    fp = {c: merkle.fingerprint(F.col(c)) for c in "abc"}
    row = df.select(*(fp[c].alias(c) for c in "abc")).select(
        "a", "b", merkle.differing(F.col("a"), F.col("b")).alias("ab"), merkle.differing(F.col("c"), F.col("a")).alias("ca"), merkle.differing(F.col("a"), F.col("a")).alias("aa"),
        merkle.root(F.col("a")).alias("root"),
    ).first()
    assert [x["leaf"] for x in row["ab"]] == [90] and row["ab"][0]["hash"] == sha(leaves[90])[:8]
    assert [x["leaf"] for x in row["ca"]] == [50] and row["aa"] == [] and row["root"] == row["a"][:64]
    mine, other = (set(x.split("/")[1:]) for x in (row["a"], row["b"]))
    assert len(mine - other) == 1  # one section differs


def test_no_python_on_the_main_path(spark):
    plan = merkle.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|ExternalRDD|MapPartitions", plan)


def test_plans_of_near_duplicates_stay_small(spark, monkeypatch):
    """What one write plans is held in the driver; scanning lists anew for each side of a join made one of 18 joins."""
    from parlance.llm import setjoin

    joins, write = {}, setjoin.written

    def noted(df, name):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(setjoin, "written", noted)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} {i}") for i in range(12)] + [(20 + i, f"{base} {' '.join(f'x{i}y{j}' for j in range(10 + 9 * i))}") for i in range(5)]
    got = {r.doc_id: r.component_id for r in setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(12)) and got[24] == 24
    assert max(joins.values()) <= 8, joins
