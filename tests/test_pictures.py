"""Near pictures against a plain loop over them."""

import random

from marlstone.operators import joins as J


def plain(rows, near):
    kept = {}
    for g, i, h in sorted(rows, key=lambda r: (r[0], r[1])):
        if h is not None and all(((h ^ x) & (2**64 - 1)).bit_count() > near for x in kept.setdefault(g, {}).values()):
            kept[g][i] = h
    return {(g, i) for g, x in kept.items() for i in x}


def test_pictures_in_blocks_are_kept_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(J, "FIRST_BLOCK", 20, raising=False)
    rng = random.Random(3)
    centres = [rng.getrandbits(63) for _ in range(6)]
    rows = [(g, 7 * i + g, rng.choice(centres) ^ sum({1 << rng.randrange(20) for _ in range(rng.randrange(9))})) for g, n in ((1, 300), (2, 40), (3, 1)) for i in range(n)]
    rows += [(2, 5000, -1), (2, 5001, -3), (1, 5002, None), (1, 5003, rows[0][2]), (4, 1, None)]
    got = J.kept_pictures(spark.createDataFrame(rows, "job int, index long, phash long"), "job").collect()
    assert len(got) == len(rows)
    assert {(r["job"], r["index"]) for r in got if r["keep"]} == plain(rows, 6)


def test_a_crowd_of_near_pictures_makes_no_pairs_with_its_square(spark, monkeypatch):
    pairs, real = [], J.near_hashes
    monkeypatch.setattr(J, "near_hashes", lambda *a: pairs.append(real(*a)) or pairs[-1])
    made = []
    monkeypatch.setattr(J, "written", lambda df, name, f=J.written: (lambda out: made.append(out.count()) or out if name == "pairs" else out)(f(df, name)))
    rows = [(1, i, (1 << (i % 61)) ^ (1 << (i * 13 % 59))) for i in range(2500)]
    got = J.kept_pictures(spark.createDataFrame(rows, "job int, index long, phash long"), "job")
    assert got.filter("keep").count() == len(plain(rows, 6))
    assert 0 < sum(made) < 200_000  # of 3,100,000 at most
