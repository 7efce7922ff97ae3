"""Edge cases of the Hamming search and of the toxicity score: nulls, repeats, ties, empty tables, clashing columns, long texts."""

import random


def test_hamming_search_of_odd_tables(spark):
    from variantloom.llm.hamming import hamming_topk

    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, -1, 7, rng.getrandbits(63), -(2**63)])) for i in range(0, 60)]
    rows += [rows[3], rows[3], (None, 5), (70, None), (None, None), (5, 12345)]  # repeats, nulls, one id with two codes
    df = spark.createDataFrame([(i, c, "clash", 1, 2, 3) for i, c in rows], "id long, code long, query_id string, rank int, distance int, n int")
    queries = df.filter("id % 10 = 0 or id = 5 or id is null")
    kept = {(i, c) for i, c in rows if i is not None and c is not None}
    want = []
    for q in sorted({i for i, _ in kept if i % 10 == 0 or i == 5}):
        best = {}
        for i, c in kept:
            if i != q:
                best[i] = min(bin((c ^ d) & (2**64 - 1)).count("1") for j, d in kept if j == q) if i not in best else min(best[i], min(bin((c ^ d) & (2**64 - 1)).count("1") for j, d in kept if j == q))
        want += [(q, n, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:6], 1)]
    got = sorted(tuple(r) for r in hamming_topk(df, queries, k=6).select("query_id", "rank", "id", "distance").collect())
    assert got == want
    assert hamming_topk(df, queries.limit(0), k=6).count() == 0 and hamming_topk(df.limit(0), df.limit(0), k=6).count() == 0
    two = df.filter("id in (1, 2)")
    assert sorted((r["query_id"], r["id"]) for r in hamming_topk(two, two, k=6).collect()) == [(1, 2), (2, 1)]


def test_toxicity_of_odd_tables(spark):
    from variantloom.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(2)
    mild, harsh = [f"good{i}" for i in range(30)], [f"vile{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(harsh if i % 2 else mild, k=20))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(None, 1), (900, None), (3, 1)], "doc_id long, toxic int")
    odd = [(500, None), (501, ""), (502, " \n"), (503, " ".join(rng.choices(harsh, k=60_000))), (504, rows[1][1]), (1, rows[1][1]), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows + odd], "doc_id long, text string, predicted string, score double")
    scored = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    told = {}
    for r in scored:
        told.setdefault(r["id"], []).append(r["score"])
    assert len(set(told[1])) == 1 and len(told[1]) == 2 and told[504] == told[1][:1]  # equal texts, equal scores
    assert told[503][0] > 0.5 and len(set(told[500] + told[501] + told[502])) == 1
    held = [(r["predicted"], r["id"] % 2) for r in scored if r["id"] is not None and 160 <= r["id"] < 200]
    assert sum(a == b for a, b in held) >= 38
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, labels)).count() == 0
