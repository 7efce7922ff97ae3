"""Kinship: from genotypes by sums over markers, from pedigrees by recursion within a family."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .bandjoin import by_blocks
from .tiles import pair_products


def kinship_markers(summary: DataFrame, least_maf: float = 0.05, most_missing: float = 0.05, x_label: str = "X", on_x: bool = False) -> DataFrame:
    """chrom, pos, af of the variants to build from: common enough, called enough, on the X or off it, and their place's only variant.

    On the X the marker's variance (column ``variance`` of ``summary``) comes along, and markers
    that don't vary fall out.
    """
    maf = F.least("all_af", 1 - F.col("all_af"))
    place = (F.col("chrom") == x_label) if on_x else (F.col("chrom") != x_label)
    found = summary.filter((maf >= least_maf) & (1 - F.col("call_rate") <= most_missing) & place)
    if "alt" in summary.columns:
        found = found.join(summary.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("here")).filter("here = 1").drop("here"), ["chrom", "pos"], "left_semi")
    found = found.select("chrom", "pos", F.col("all_af").alias("af"), *(["variance"] if on_x else []))
    return found.filter("variance > 0") if on_x else found


def marker_summary(calls: DataFrame, sites: DataFrame | None = None, samples: int = 0) -> DataFrame:
    """chrom, pos, ref, alt, all_af, call_rate, variance of ``calls`` (a row for every sample; null dose is missing).

    With ``sites`` (chrom, pos, ref, alt, lines) of so many ``samples``, rows of dose 0 may be absent.
    """
    if sites is not None:
        site = ["chrom", "pos", "ref", "alt"]
        sums = calls.groupBy(*site).agg(F.sum("dose").alias("s"), F.sum(F.col("dose") * F.col("dose")).alias("ss"), F.count_if(F.col("dose").isNull()).alias("missing"))
        j = sites.join(sums, site, "left").fillna(0, ["missing"]).fillna(0.0, ["s", "ss"]).withColumn("all", F.lit(samples) * F.col("lines")).withColumn("n", F.col("all") - F.col("missing"))
        mean = F.col("s") / F.col("n")
        return j.filter("n > 0").select(*site, (mean / 2).alias("all_af"), (F.col("n") / F.col("all")).alias("call_rate"), (F.col("ss") / F.col("n") - mean * mean).alias("variance"))
    return calls.groupBy("chrom", "pos", "ref", "alt").agg((F.avg("dose") / 2).alias("all_af"), (F.count("dose") / F.count(F.lit(1))).alias("call_rate"), F.var_pop("dose").alias("variance"))


def empirical_kinship(calls: DataFrame, samples: DataFrame, least_maf: float = 0.05, most_missing: float = 0.05, x_label: str = "X", on_x: bool = False, sites: DataFrame | None = None) -> DataFrame:
    """(a, b, k), a <= b, from the genotypes of ``calls``; on the X, where males count 0 or 2, divided by each marker's own variance.

    With ``sites`` rows of dose 0 may be absent (see :func:`marker_summary`). Missing genotypes count as the marker's mean. No marker that qualifies raises.
    """
    markers = written(kinship_markers(marker_summary(calls, sites, samples.count() if sites is not None else 0), least_maf, most_missing, x_label, on_x), "kinship-markers")
    if markers.isEmpty():
        raise ValueError(f"no marker qualifies for the kinship matrix{' of the X' if on_x else ''}")
    filled = calls.join(markers.select("chrom", "pos", "af"), ["chrom", "pos"]).withColumn("dose", F.coalesce("dose", 2 * F.col("af"))).filter("dose > 0")
    return grm(filled.select("chrom", "pos", "sample", "dose"), markers, samples, by_variance=on_x)


def grm(nonzero: DataFrame, markers: DataFrame, samples: DataFrame, by_variance: bool = False, common: bool = False, block: int = 512) -> DataFrame:
    """(a, b, k), a <= b, for every pair of ``samples``: mean over markers of (x_a - 2p)(x_b - 2p) / (2p(1-p)); rows of dose 0 are absent.

    From carriers alone: with w = 1/(2p(1-p)), the sum is S_ab - L_a - L_b + C where S sums
    w x_a x_b over common carriers, L sums 2 p w x_a and C sums 4 p^2 w. S is worked out in
    tiles, blocks of samples by blocks of markers. ``by_variance`` divides by the marker's
    column ``variance`` (X chromosome). A missing genotype counts as the marker's mean 2p:
    give it that dose. ``common`` adds the number of markers that both carry. No markers give
    no pairs.
    """
    p = F.col("af")
    var = F.col("variance") if by_variance else 2 * p * (1 - p)
    m = markers.withColumn("w", 1 / var)
    x = nonzero.join(m, ["chrom", "pos"]).select(F.concat_ws(":", "chrom", "pos").alias("marker"), "sample", (F.col("dose") * F.sqrt("w")).alias("x"), (2 * p * F.col("w") * F.col("dose")).alias("l"))
    facts = m.agg(F.count(F.lit(1)).alias("markers"), F.coalesce(F.sum(4 * p * p * F.col("w")), F.lit(0.0)).alias("c")).first()
    people = samples.select("sample").distinct()
    if not facts["markers"]:
        return people.select(F.col("sample").alias("a"), F.col("sample").alias("b"), F.lit(None).cast("double").alias("k"), *([F.lit(0).cast("long").alias("common")] if common else [])).limit(0)
    own = people.join(x.groupBy("sample").agg(F.sum("l").alias("l")), "sample", "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    s = pair_products(x.join(people, "sample", "left_semi"), people, "sample", "marker", "x", people.count(), facts["markers"], block)
    la, lb = own.select(F.col("sample").alias("a"), F.col("l").alias("la")), own.select(F.col("sample").alias("b"), F.col("l").alias("lb"))
    return s.join(la, "a").join(lb, "b").select("a", "b", ((F.col("product") - F.col("la") - F.col("lb") + F.lit(facts["c"])) / F.lit(facts["markers"])).alias("k"), *(["common"] if common else []))


def pedigree_kinship(samples: DataFrame, x_linked: bool = False, male: int = 1) -> DataFrame:
    """(famid, a, b, k), both triangles, by the recursion over parents, a family at a time.

    Founders have 1/2 with themselves (on the X, males 1) and 0 with each other. Equal
    zygosity marks (MZ) of full siblings make them one person. A family is as large as its
    pedigree; families are independent.
    """
    import pandas as pd

    def family(famid, rows: list) -> list[tuple]:
        people = {r.pid: r for r in rows}
        parents = {p: (r.father if r.father in people else None, r.mother if r.mother in people else None) for p, r in people.items()}
        depth: dict[str, int] = {}

        def generation(p: str) -> int:
            if p not in depth:
                depth[p] = 0
                depth[p] = 1 + max([generation(q) for q in parents[p] if q], default=-1)
            return depth[p]

        order = sorted(people, key=lambda p: (generation(p), p))
        twin: dict[str, str] = {}
        marks: dict[tuple, str] = {}
        for p in order:
            mark = str(people[p].zygosity or "")
            if mark.upper() in ("MZ", "1", "3", "5", "7", "9") and any(parents[p]):
                twin[p] = marks.setdefault((mark, parents[p]), p)
            else:
                twin[p] = p
        k: dict[tuple[str, str], float] = {}

        def get(a, b) -> float:
            return k.get((twin[a], twin[b]), 0.0) if a and b else 0.0

        for i, p in enumerate(order):
            if twin[p] != p:
                continue
            father, mother = parents[p]
            son = x_linked and people[p].sex == male
            for q in [x for x in order[:i] if twin[x] == x]:
                v = get(mother, q) if son else (get(father, q) + get(mother, q)) / 2
                k[p, q] = k[q, p] = v
            k[p, p] = 1.0 if son else 0.5 + (get(father, mother) / 2)
        return [(famid, a, b, get(a, b)) for a in order for b in order]

    def families(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for famid, rows in groupby(pdf.itertuples(index=False), lambda r: r.famid):
            out += family(famid, list(rows))
        return pd.DataFrame(out, columns=["famid", "a", "b", "k"])

    cols = samples.select("famid", "pid", "father", "mother", "sex", "zygosity")
    return by_blocks(cols, ["famid"], families, "famid string, a string, b string, k double")


def family_rotation(kinship: DataFrame) -> DataFrame:
    """(famid, members, values, vectors flattened): each family's 2K decomposed by itself, so the whole rotation is block-diagonal."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="k")
        m = m.reindex(columns=m.index).fillna(0)
        values, vectors = np.linalg.eigh(2 * m.to_numpy())
        return pd.DataFrame([(pdf["famid"].iloc[0], list(m.index), values.tolist(), vectors.ravel().tolist())], columns=["famid", "members", "values", "vectors"])

    return kinship.groupBy("famid").applyInPandas(one, "famid string, members array<string>, values array<double>, vectors array<double>")
