"""The Jaccard join, the mix and the vector search against brute force."""

import random

import numpy as np
import pytest

from marlstone.llm import anisotropic_search as S
from marlstone.llm import jaccard_join as J
from marlstone.llm import mix_schedule as M


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {("#", *w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                links.add((min(i, j), max(i, j)))
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i is None, i or 0, len(s), None if i is None else root(i)) for i, s in sets)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 90)))) for k in range(60)]
    for base in range(8):  # near copies, some a chain of small steps
        words = rows[base][1].split()
        for _ in range(12):
            words = list(words)
            if rng.random() < 0.7 and len(words) > 4:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    shared = " ".join(rng.choice(vocab) for _ in range(70))
    rows += [(len(rows) + k, f"{shared} {' '.join(rng.choice(vocab) for _ in range(k))}") for k in range(12)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "two one"), (None, rows[0][1]), (None, None), (507, rows[0][1].upper()), (508, "é É ß"), (509, "x " * 5000), (510, "x x x x")]
    return rows


def test_jaccard_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, c int").repartition(5)
    got, links = J.join(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)
    assert links.count() > 0
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for n, i, _, c in brute(rows) if not n}) and ids.count(None) == 2


def test_jaccard_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (1, "q r s")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.join(docs)[0].collect()} == {(1, 1), (2, 1)}
    assert J.keep_one(docs).count() == 1
    assert J.join(docs.limit(0))[0].count() == 0
    assert J.join(spark.createDataFrame([(3, "lonely words here")], "doc_id long, text string"))[0].collect()[0].component_id == 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in up.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_prefix_lengths():
    for n in range(1, 400):
        least = next(k for k in range(n + 1) if 100 * k >= 90 * n)
        assert J.prefix_length(n, 90) == n - least + 1


def fill(sizes, weights=(5, 2, 1)):
    """Targets by giving the excess away again and again."""
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mix(spark, block):
    rng = random.Random(9)
    rows = [(k, "word " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", None, "é"])) for k in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "x y", "tiny"), (None, "n u l l", "b"), (3, "again", "a"), (3, "again", "a"), (1003, "z " * 3000, "a")]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(3)
    facts, taken = M.mix(docs, block=block)
    got = {r.row: r for r in facts.collect()}
    n, passes = dict.fromkeys(got, 0), {}
    for r in taken.collect():
        n[r.row] += r.n
        assert 0 <= r.first and r.first + r.n <= got[r.row].size and r.n > 0 and r.round < 3
        passes.setdefault((r.row, r.round), []).append((r.first, r.n))
    for parts in passes.values():  # the parts of a pass lie end to end from the start
        at = 0
        for first, k in sorted(parts):
            assert first == at
            at += k
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    taken_of = {}
    for row, r in got.items():
        s = r.key[1:] if r.key != "n" else None
        taken_of[s] = taken_of.get(s, 0) + n[row]
        assert n[row] <= 3 * r.size and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken_of[s] - want[s]) <= 1 for s in sizes)
    slots = {r.slot for r in taken.collect()}
    assert len(slots) <= sum(sizes.values()) / block + 7
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(taken_of.values())


def test_mixed_documents_give_passes_to_their_own_source(spark):
    """Rows without id, of one id, and alike but for their source, all of one size."""
    rows = [(None if k % 2 else 7, f"w{k % 5} " * 3, "abc"[k % 3]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = {}
    for r in M.mixed_documents(docs).collect():
        out[r.source] = out.get(r.source, 0) + len(r.text.split())
    want = fill(dict.fromkeys("abc", 240))
    assert all(abs(out[s] - want[s]) <= 1 for s in "abc")
    assert M.sizes(docs).filter("doc_id is null").select("digest").distinct().count() == 120


def test_mix_runs_hold_every_source_in_proportion(spark):
    docs = spark.createDataFrame([(k, "w " * 100, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    sources = M.targets(M.sizes(docs))
    plan = M.slots(spark, sources, 800).orderBy("slot").collect()
    assert [r.slot for r in plan] == list(range(800))
    for start in range(0, 720, 80):
        part = [r.key for r in plan[start : start + 80]]
        assert abs(part.count("sa") - 50) <= 3 and abs(part.count("sb") - 20) <= 3 and abs(part.count("sc") - 10) <= 3


def test_mix_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    for rows in (docs.limit(0), docs.selectExpr("doc_id", "cast(null as string) as text", "source")):
        facts, taken = M.mix(rows)
        assert taken.count() == 0 and facts.count() == rows.count()
        assert M.mixed_documents(rows).count() == 0


def nearest(rows, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 12}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q))[:k]
    return out


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=12).astype(np.float32).tolist()) for k in range(3000)]
    same = rows[17][1]
    rows += [(k, same) for k in range(3000, 3400)]
    rows += [(4000, None), (4020, []), (4040, [0.0] * 12), (4060, [1.0] * 11 + [None]), (4080, [1.0] * 11 + [float("nan")]), (4100, [float("inf")] + [0.0] * 11), (4120, [1.0] * 5), (None, [1.0] * 12), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, 0.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in S.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = nearest(rows)
    assert set(got) == set(want)
    vectors = {i: np.array(v, float) for i, v in rows if v and i is not None and i < 4000}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(np.isclose(s, (vectors[q] * vectors[i]).sum(), atol=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit / (20 * len(want)) >= 0.97


def test_search_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.search(df).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 20, 5.0), (20, 1, 1, 10.0), (20, 2, 0, 5.0)]
    assert S.search(df.limit(0)).count() == 0


def test_anisotropic_codes_lose_less_along_the_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(threshold):
        books = S.train(x, threshold)
        codes = S.encode(x, books, S._eta(16, threshold))
        r = x - np.stack([books[m][codes[:, m]] for m in range(8)], axis=1).reshape(2000, 16)
        return ((r * unit).sum(1) ** 2).mean()

    assert parallel(0.6) < 0.5 * parallel(0.0)


def test_search_recall_over_many_blocks_and_on_a_full_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(S.LARGEST_BLOCK, 16))
    books = S.train(x[:4000])
    codes = S.encode(x, books, S._eta(16, S.THRESHOLD)).astype(np.uint8)
    packed = np.ascontiguousarray((codes[:, ::2] << 4 | codes[:, 1::2]).T)
    ids, at = np.arange(len(x)), np.arange(len(x) + 1)
    hit = []
    for q in x[:40]:
        got = S._nearest(-1, q, S.scan(q[None], books, packed)[0], x, ids, at, 20, S.RERANK)[1]
        hit.append(len(set(got) & set(np.argsort(-(x @ q))[:20])) / 20)
    assert np.mean(hit) >= 0.9
    monkeypatch.setattr(S, "BLOCK", 100)
    monkeypatch.setattr(S, "BLOCKS", 1 << 20)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1000, 12)))]
    got = {}
    for r in S.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(rows)
    assert set(got) == set(want)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) / (20 * len(want)) >= 0.99


def test_jaccard_with_tiny_tables_and_slices(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.join(docs, bits=6, slice_tokens=50)[0].collect())
    assert got == brute(rows)


def test_ids_of_several_texts_join_their_classes(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (11, "other words here")]
    got = sorted((r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (9, 3), (11, 11)]
