"""Tiles of covariances: buckets cut into blocks of columns, arrays as values, matrices beside pairs of cells."""

import numpy as np

from variantloom.operators import genes, genotypes, tiles


def test_pairs_of_cells_and_matrices_agree(monkeypatch):
    rng = np.random.default_rng(3)
    dense = rng.integers(-2, 3, (30, 12)) * (rng.random((30, 12)) < 0.4)
    rows, column = np.nonzero(dense)
    value = dense[rows, column].astype(float)
    starts = np.arange(30)
    ends = np.where(starts < 20, np.minimum(starts + 7, 30), starts)
    told = []
    for denser, chunk, pairs in ((40, 512, 10**6), (1e-9, 512, 9), (1e9, 4, 10**6)):
        monkeypatch.setattr(tiles, "DENSER", denser)
        monkeypatch.setattr(tiles, "CHUNK", chunk)
        monkeypatch.setattr(tiles, "PAIRS", pairs)
        told.append(tiles._in_band(starts, ends, rows, column, value, 12))
    want = np.array([dense[i] @ dense[j] for i in range(20) for j in range(i, ends[i])])
    met = np.array([bool((dense[i] * dense[j] != 0).any()) for i in range(20) for j in range(i, ends[i])])
    assert all((p == want).all() and (m == met).all() for p, m in told)


def test_crowded_buckets_and_few_groups(spark, monkeypatch):
    """Covariances don't depend on blocks or on a bucket's width, and few cells make few groups, however many samples there are."""
    rng = np.random.default_rng(4)
    rows = sorted({(0, int(s), "1", int(p)) for p in rng.integers(0, 3000, 90) for s in rng.integers(0, 40, 4)})
    df = spark.createDataFrame([(*r, float(1 + (r[1] + r[3]) % 2)) for r in rows], "study int, sample int, chrom string, pos int, dose double")
    groups = spark.createDataFrame([(0, 40, 1.5)], "study int, n long, sigma2 double")
    get = lambda: {(r["pos"], r["pos2"]): r["cov"] for r in genotypes.ld_covariance(df, groups, ["study"], 60).collect()}
    g = {}
    for _, s, _, p in rows:
        g.setdefault(p, np.zeros(40))[s] = 1 + (s + p) % 2
    want = {(p, q): float((g[p] @ g[q] - g[p].sum() * g[q].sum() / 40) / 1.5 / 40) for p in g for q in g if 0 <= q - p <= 60}
    for cells, columns, filled in ((10**6, 4096, 4000), (5, 7, 1)):
        for name, v in (("CELLS", cells), ("COLUMNS", columns), ("FILLED", filled)):
            monkeypatch.setattr(tiles, name, v)
        got = get()
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_gene_pairs_come_from_the_rows_there_are(spark):
    """A gene of variants far apart has no pair of them to make; thresholds add up along their frequencies."""
    kept = spark.createDataFrame([("g", i, "1", 1000 * i, 0.01 * (1 + i % 3), float(i), 1.0) for i in range(5)], "gene string, ord int, chrom string, pos int, af double, u double, sign double")
    cov = spark.createDataFrame([(0, "1", 1000 * i, 1000 * i, 1.0) for i in range(5)] + [(0, "1", 0, 1000, 0.5)], "study int, chrom string, pos int, pos2 int, cov double")
    c = genes.gene_covariance(kept, cov)
    assert {(r["i"], r["j"]): r["cov"] for r in c.collect()} == {**{(i, i): 1.0 for i in range(5)}, (0, 1): 0.5}
    got = {round(r["cutoff"], 4): (r["num_var"], r["s"], r["var"]) for r in genes.vt_scores(kept, c).collect()}
    assert got == {0.01: (2, 3.0, 2.0), 0.02: (4, 8.0, 5.0), 0.03: (5, 10.0, 6.0)}
