"""Neighbours, near copies, repeated passages, toxicity and the pipeline: against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelens.llm import near_copies, neighbours, repeats, toxicity
from linelens.llm.bwt import repeated_starts


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32) * rng.uniform(0.5, 2, size=(400, 1)).astype(np.float32)
    x[3] *= 5
    x[50:80] = x[3]  # a hot vector
    rows = [(int(k), [float(v) for v in x[k]], 1) for k in range(400)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (1060, [None] + [1.0] * 15, 1), (1080, [], 1), (1100, [float("inf")] + [0.0] * 15, 1), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    x, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-9 for _, v, c in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({int(w) for w in want} & {v for _, v, _ in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[60]] == [3, 50, 51, 52, 53]


def test_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 5  # an outlier
    mixed = x * np.exp(0.5 * rng.normal(size=(4000, 1)))
    for table in (x, mixed):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(table.tolist())], "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
            got[r.query_id].add(r.vec_id)
        s = table[::100] @ table.T
        s[np.arange(40), np.arange(40) * 100] = -np.inf
        want = np.argsort(-s, axis=1)[:, :20]
        assert sum(len(got[100 * q] & set(w.tolist())) for q, w in enumerate(want)) / want.size >= 0.95
    assert Counter(r.n for r in spark.createDataFrame([([3e200, 4e200],), ([3e-200, 4e-200],)], "v array<double>").select(neighbours.length_class(F.col("v")).alias("n")).collect()) == Counter([1333, -1324])


def test_small_tables_are_hashed_too(spark):
    table = np.random.default_rng(11).normal(size=(500, 64))
    table /= np.linalg.norm(table, axis=1)[:, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(table.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    s = table[::20] @ table.T
    s[np.arange(25), np.arange(25) * 20] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    recall = sum(len(got[20 * q] & set(w.tolist())) for q, w in enumerate(want)) / want.size
    assert 0.95 <= recall and all(len(f) == 20 for f in got.values())


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(0, 60, 10)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in got) == {0: 5, 20: 5, 40: 5}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose((neighbours.hadamard(x) ** 2).sum(1), (x**2).sum(1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def shingle_counts(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def brute_classes(rows, threshold=0.8):
    sets = [shingle_counts(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            both = sum(sets[i].values()) + sum(sets[j].values()) - common
            if (both == 0 and not sets[i] and not sets[j]) or (both and common / both >= threshold):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        groups[root(i)].append(d)
    return {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 2])
def test_classes_match_brute_force(spark, rows, docs, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)  # 2: every star is compared across chunks
    label, root = brute_classes(rows)
    want = Counter((d, label[root[i]]) for i, (d, _, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id) for r in near_copies.near_copies(docs).collect()) == want


def test_one_of_each_keeps_columns(docs, rows, no_docs):
    out = near_copies.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == len(brute_classes(rows)[0])
    assert near_copies.one_of_each(no_docs).count() == 0 and near_copies.near_copies(no_docs).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(20):
        ids = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        hashes, weights = np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
        s = near_copies.signatures(hashes, weights, np.array([0, (a > 0).sum(), len(hashes)]), 1024)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.06


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"length": 60, "gram": 16, "group_bytes": 2000, "text_bytes": 5000}, {"length": 60, "gram": 60}])
def test_repeats_match_brute_force(docs, rows, options):
    want = brute_repeats([(t or "").encode() for _, t, _ in rows], options.get("length", repeats.LENGTH))
    got = repeats.repeated_passages(docs, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((d, *w) for (d, _, _), w in zip(rows, want))


def test_backward_extension_matches_counting():
    rng = random.Random(7)
    for _ in range(150):
        length, letters = rng.randint(1, 30), rng.choice([1, 2, 4, 200])
        base = [rng.randint(1, letters) for _ in range(120)]
        parts = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randint(0, 100)
            parts.append([rng.randint(1, letters) for _ in range(rng.randint(0, 15))] + base[at : at + rng.randint(0, 60)])
        seen = Counter(tuple(p[i : i + length]) for p in parts for i in range(len(p) - length + 1))
        want = [x for p in parts for x in [len(p) - i >= length and seen[tuple(p[i : i + length])] > 1 for i in range(len(p))] + [False]]
        text = np.array([x for p in parts for x in p + [0]], dtype=np.uint16)
        assert repeated_starts(text, length).tolist() == want


def test_without_repeats(docs, no_docs):
    out = repeats.without_repeats(docs, length=60, gram=16)
    assert out.columns == docs.columns and {r["th"] for r in out.collect()} == {"t"}
    again = repeats.repeated_passages(out, length=200).where("n_removed > 0").count()
    assert again == 0 and repeats.without_repeats(no_docs).count() == 0 and repeats.repeated_passages(no_docs).count() == 0


INSULTS = ["grobbel", "fnarkle", "zwickpo"]


def toxic_corpus(n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        w = ["".join(rng.choice(["ma", "te", "lo", "in", "ga"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(INSULTS) + rng.choice(["", "ed", "ish"])
        rows.append((k, " ".join(w), "s"))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_generalises(spark):
    from tests.llm.conftest import table

    rows, labels = toxic_corpus()
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "you grobbel", "s"), (5002, "gr0bbel " * 3 + "you gr0bbel", "s")]
    docs = table(spark, rows)
    given = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (labels[4][0], 0, labels[4][2])], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, given)
    out = model.score(docs)
    assert sorted(docs.columns) == sorted(out.columns)  # a column named score was there and is replaced
    got = {r.doc_id: r.score for r in out.collect()}
    held = [(got[d], t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] < 0.5 <= got[5002]
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.95


def test_toxicity_without_labels(spark, docs, no_docs):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.s for r in toxicity.fit(docs, nothing).score(docs, into="s").collect()} == {0.0}
    assert toxicity.fit(no_docs, nothing).score(no_docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from linelens.session import materialize
    from tests.llm.conftest import corpus, table

    rows, labels = toxic_corpus(400)
    rows = [(d + 10_000, t, s) for d, t, s in rows] + [r for r in corpus() if r[0] is not None]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d + 10_000, q, t) for d, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sizes = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        sizes.append(docs.count())
        if len(sizes) == 1:
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            toxic = {d + 10_000 for d, _, t in labels if t}
            assert len(kept & toxic) < 0.2 * len(toxic) and len(toxic | kept) >= 0.97 * len({d for d, _, _ in rows})
        if len(sizes) == 2:
            assert len(kept & {100, 101, 102}) > 1 and len({r.doc_id for r in docs.select("doc_id").collect()} & {100, 101, 102, 1}) == 1
        assert len(sizes) == 5 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and sizes[0] > sizes[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
