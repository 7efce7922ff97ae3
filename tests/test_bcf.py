"""BCF beside VCF: the same rows whatever the splits; regions, ploidies, missing calls, several files."""

import random

import pytest

from variantloom.sources import bcf, readers


def vcf(path, samples=40, sites=300, seed=2):
    rng = random.Random(seed)
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(samples))])]
    for i in range(sites):
        alt = rng.choice(["C", "C,G", "T" * 20, "."])
        calls = [rng.choice(["0/0", "0/1", "1|1", "./.", "0/2" if "," in alt else "0|1", "1", "."]) if alt != "." else "0/0" for _ in range(samples)]
        lines.append("\t".join([f"chr{1 + i // 100}", str(10 * i + 1), ".", "A", alt, ".", ".", ".", "GT", *calls]))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.select("chrom", "pos", "ref", "alt", "sample", "dose", "ploidy").collect()), key=repr)


def test_bcf_equals_vcf(spark, tmp_path, monkeypatch):
    text = vcf(tmp_path / "v.vcf")
    want = rows(readers.read_genotypes(spark, text))
    names = bcf.write_bcf(spark, text, str(tmp_path / "folder.bcf"))
    assert names and rows(readers.read_genotypes(spark, str(tmp_path / "folder.bcf"))) == want
    assert rows(readers.read_genotypes(spark, str(tmp_path / "folder.bcf"), region="chr2:1001-1500")) == [r for r in want if r[0] == "2" and 1001 <= r[1] <= 1500]

    # one file of small blocks, cut at places that fit neither blocks nor records
    monkeypatch.setattr(bcf, "BLOCK", 700)
    lines = readers.read_vcf_lines(spark, text).orderBy("chrom", "pos").collect()
    one = tmp_path / "one.bcf"
    samples = readers.vcf_samples(spark, text)
    one.write_bytes(b"".join(bcf.encode(samples, ["1", "2", "3"], ((r["chrom"], r["pos"], r["ref"], r["alts"], r["calls"]) for r in lines))))
    for split in (100, 1013, 5000, 1 << 20):
        assert rows(bcf.read_bcf(spark, str(one), split_bytes=split)) == want, split
    assert bcf.read_bcf(spark, str(one), "DS").count() == 0


def test_bcf_edges(spark, tmp_path):
    empty = tmp_path / "empty.bcf"
    empty.write_bytes(b"".join(bcf.encode(["a", "b"], ["1"], [])))
    assert bcf.read_bcf(spark, str(empty), split_bytes=64).count() == 0
    one = tmp_path / "single.bcf"
    one.write_bytes(b"".join(bcf.encode(["a", "b"], ["1"], [("1", 5, "A", ["C"], ["0/1", "./1"])])))
    assert rows(bcf.read_bcf(spark, str(one))) == [("1", 5, "A", "C", "a", 1.0, 2), ("1", 5, "A", "C", "b", None, 2)]
    wrong = tmp_path / "wrong.bcf"
    wrong.write_bytes(bcf.bgzf(b"something else") + bcf.bgzf(b""))
    with pytest.raises(Exception, match="not a BCF"):
        bcf.read_bcf(spark, str(wrong)).count()
    cut = tmp_path / "cut.bcf"
    cut.write_bytes(one.read_bytes()[:-40])
    with pytest.raises(Exception, match="BGZF block|ends within"):
        bcf.read_bcf(spark, str(cut)).count()
