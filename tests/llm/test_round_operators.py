"""Periodic runs, tokenizer alignment and SimHash components, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers

from linelens.llm import alignment, periods, simhash
from linelens.llm.components import components
from linelens.llm.pieces import byte_letters

WORDS = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_runs(w, least):
    """Every period by itself: maximal stretches, without those of a smaller period."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if i > start and n >= max(least, 2 * q):
                seg = w[start : start + n]
                if not any(seg[d:] == seg[:-d] for d in range(1, q)):
                    out.add((start, n, q))
            i += 1
    return sorted(out)


def plain_collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for trial in range(1500):
        k, n, least, w = rng.choice([1, 2, 3, 5]), rng.randint(0, 60), rng.choice([12, 12, 5, 1]), []
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        while len(w) < n:
            w += unit * rng.randint(1, 6) + [rng.randrange(k + 2) for _ in range(rng.randint(0, 4))]
        if trial % 3 == 0:
            w = [rng.randrange(k) for _ in range(n)]
        w = [b"%d" % x for x in w]
        (n, runs, kept), other = periods._block([b" ".join(w), w[0] if w else b""], least)
        assert runs == plain_runs(w, least) and n == len(w) and other[0] == bool(w)
        assert kept.decode() == plain_collapse([x.decode() for x in w], runs)


def test_one_word_and_long_periods():
    (n, runs, kept), = periods._block([b"x " * 30000], 12)
    assert (n, runs, kept) == (30000, [(0, 30000, 1)], b"x")
    unit = [b"%d" % k for k in range(4000)]
    (_, runs, kept), = periods._block([b" ".join([b"a"] + unit * 2 + unit[:7] + [b"z"])], 12)
    assert runs == [(1, 8007, 4000)] and kept == b" ".join([b"a"] + unit + [b"z"])


def test_runs_of_rows(docs, rows, no_docs):
    found = sorted((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect())
    want = []
    for d, t, _ in rows:
        w = WORDS(t)
        runs = plain_runs(w, 12) if len(w) < 1000 else []
        want.append((d is None, d, len(w), runs, plain_collapse(w, runs)))
    assert found == sorted(want)
    assert periods.periodic_runs(no_docs).count() == 0
    assert any(f[1] == 404 and f[3] == [(0, 400, 1)] for f in found)


def test_run_query(spark, docs, rows, tmp_path):
    rng = random.Random(8)
    more = [(1000 + k, " ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuv") for _ in range(80 + k)), "s0") for k in range(40)]
    rows = rows + more
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").union(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = {}, {}
    for r in periods.query(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for d, t, _ in rows:
        if d is None:
            continue
        w, h = WORDS(t), zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w, 12) if n < 1000 or h % 10 == 0 else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        want.setdefault(d, []).append((len(runs), *facts, digest, hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()))
    order = lambda x: {d: sorted(map(str, v)) for d, v in x.items()}
    assert order(got) == order(want)
    assert sum(v[0][0] > 0 for v in got.values()) >= 4


def plain_fingerprint(text, n=3):
    import xxhash

    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORDS(w)
    parts = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    label = {v: v for v in values}
    order = sorted(label)
    changed = True
    while changed:
        changed = False
        for x in order:
            for y in order:
                if bin(x ^ y).count("1") <= radius and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return label


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = list({rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for _ in range(700)})
    tree = simhash.Tree(2)
    for k, x in enumerate(values):
        assert sorted(tree.search(x)) == [i for i in range(k) if bin(values[i] ^ x).count("1") <= 2]
        tree.add(x)


def test_links_connect_like_all_pairs(spark):
    rng = random.Random(4)
    for free, tree in ((64, 4096), (12, 4096), (12, 20)):  # 12 free bits: large shards, cut once more
        base = rng.getrandbits(64)
        bits = rng.sample(range(64), free)
        centres = [base ^ sum(rng.getrandbits(1) << b for b in bits) for _ in range(30)]
        values = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 3))) for _ in range(250)}
        nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
        found = {r.key % 2**64: r.root % 2**64 for r in components(simhash.links(nodes, 2, tree)).collect()}
        got = {}
        for v in values:
            got.setdefault(found.get(v, v), set()).add(v)
        want = {}
        for v, root in plain_components(values, 2).items():
            want.setdefault(root, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprints_and_components(spark, docs, rows, no_docs):
    got = simhash.near_fingerprints(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t, _ in rows}
    label = plain_components(set(prints.values()), 2)
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            root = label[prints[t]]
            smallest[root] = min(smallest.get(root, d), d)
    want = [(d, prints[t], smallest.get(label[prints[t]])) for d, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got)
    assert len({w[2] for w in want}) < len({w[1] for w in want}) < len(rows)
    assert simhash.near_fingerprints(no_docs).count() == 0


def test_fingerprint_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.query(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.fingerprint for r in got}[401] == "0" * 16
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got) and len(got) == docs.count()


def test_components_of_a_large_star_and_a_chain(spark):
    star = [(0, k) for k in range(1, 3000)]
    chain = [(k, k + 1) for k in range(10_000, 10_200)]
    edges = spark.createDataFrame(star + chain + [(7, 7)], "a long, b long")
    found = {r.key: r.root for r in components(edges).collect()}
    assert found == {k: 0 for k in range(1, 3000)} | {k: 10_000 for k in range(10_001, 10_201)}
    assert components(edges.where("a < 0")).count() == 0


def plain_alignment(text, a, b, bytes_a, bytes_b):
    """Ids, groups and links by comparing every end and walking every range."""
    ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    data = (" " + text).encode()
    if not text or b"".join(bytes_a(i) for i in ids_a) != data or b"".join(bytes_b(i) for i in ids_b) != data:
        return [], [], [], []

    def ranges(ids, value):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(value(i))))
            at = out[-1][1]
        return out

    ra, rb = ranges(ids_a, bytes_a), ranges(ids_b, bytes_b)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    part = lambda ids, spans, low, high: ",".join(str(i) for i, (s, e) in zip(ids, spans) if low <= s and e <= high)
    groups = [part(ids_a, ra, low, high) + "|" + part(ids_b, rb, low, high) for low, high in zip([0] + cuts, cuts)]
    links = [(i, j) for i, (s, e) in zip(ids_a, ra) for j, (t, u) in zip(ids_b, rb) if s < u and t < e]
    return ids_a, ids_b, groups, links


def test_alignment(spark, docs, rows, no_docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = (public_tokenizers.path(p) for p in (alignment.TOKENIZER_A, alignment.TOKENIZER_B))
    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(byte_letters())}
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    assert alignment.Encoders(path_a, path_b)._by_ranks(path_a) is not None
    odd = ["a  b", "x \n y ", " <|endoftext|> a", "<s> <unk>", "tab\tx\n\ny", "it's 12 345", "日本語 🙂", "▁a", " x\u0085", "aé" * 300]
    more = [(2000 + k, t, "s0") for k, t in enumerate(odd)]
    long_id = 600  # its links are compared by their number alone
    rows = [r if r[0] != long_id else (r[0], r[1][:3000], r[2]) for r in rows] + more
    table = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, pair string").repartition(3)
    found = {t: plain_alignment(t or "", a, b, bytes_a, bytes_b) for _, t, _ in rows}
    counts = Counter(p for _, t, _ in rows for p in set(found[t][3]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    want = []
    for d, t, _ in rows:
        ids_a, ids_b, groups, links = found[t]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        want.append((d, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    for block_links in (2_000_000, 400):
        got = alignment.linked_counts(table, path_a, path_b, block_links)
        assert got.columns == [c.split()[0] for c in alignment.RESULT.split(", ")]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    texts = {r.doc_id: (r.a, r.b, r.groups) for r in alignment.alignments(table.where("doc_id >= 2000"), path_a, path_b).collect()}
    assert texts == {d: tuple(found[t][:3]) for d, t, _ in more}
    assert sum(w[1] == 0 for w in want) >= 3 and any(w[5] < w[4] for w in want)
    assert alignment.linked_counts(no_docs, path_a, path_b).count() == 0


def test_stretch_is_the_longest():
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randint(0, 80)
        x = bytes(rng.randrange(1, 4) for _ in range(n))
        y = x[: rng.randint(0, n)] + bytes(rng.randrange(1, 4) for _ in range(rng.randint(0, 5)))
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        assert alignment.stretch(x, y, 0, 0) == k
