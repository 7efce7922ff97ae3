"""Options of the two programs: a study's association run and the meta-analysis, one field per flag."""

from __future__ import annotations

from dataclasses import dataclass


class OptionError(ValueError):
    """Options that contradict each other or name what isn't there."""


@dataclass(frozen=True)
class MetaOptions:
    summary_files: str = ""
    cov_files: str | None = None
    group_file: str | None = None
    annotated_vcf: str | None = None
    annotation: str | None = None
    write_vcf: bool = False
    hwe: float = 1e-5
    call_rate: float = 0.95
    burden: bool = False
    mb: bool = False
    mab: bool = False
    bbeta: bool = False
    skat: bool = False
    vt: bool = False
    condition: str | None = None
    label_hits: bool = False
    gene_map: str | None = None
    correct_gc: bool = False
    prefix: str = ""
    maf: float = 0.05
    long_output: bool = False
    tabulate_hits: bool = False
    dosage: bool = False
    hits_cutoff: float = 1e-6
    alt_maf: bool = False
    range: str | None = None
    use_exact: bool = False
    norm_pop: bool = False
    pop_file: str | None = None
    relate_binary: bool = False
    debug: bool = False
    match_only: bool = False
    match_by_abs: bool = False
    match_dist: float | None = None
    min_match_maf: float = 0.0
    max_match_maf: float = 1.0
    dosage_option_file: str | None = None
    sum_case_ac: bool = False

    @property
    def gene_tests(self) -> list[str]:
        """Names of the tests asked for; a VCF of the pooled variants turns them off."""
        if self.write_vcf:
            return []
        return [name for name, on in (("burden", self.burden), ("MB", self.mb), ("MAB", self.mab), ("BBeta", self.bbeta), ("VT", self.vt), ("SKAT", self.skat)) if on]

    def checked(self) -> MetaOptions:
        """These options, or an :class:`OptionError`. Covariance files are needed for gene tests and conditions only."""
        if not self.summary_files:
            raise OptionError("a list of score files is needed")
        if self.norm_pop and not self.use_exact:
            raise OptionError("norm_pop needs use_exact")
        if self.norm_pop and not self.pop_file:
            raise OptionError("norm_pop needs pop_file: the panel's path")
        if self.relate_binary:
            raise OptionError("relate_binary has no defined correction")
        if (self.gene_tests or self.condition) and not self.cov_files:
            raise OptionError("gene tests and conditional analysis need a list of covariance files")
        if self.gene_tests and not (self.group_file or self.annotated_vcf):
            raise OptionError("gene tests need group_file or annotated_vcf")
        if not (0 < self.maf <= 0.5 and 0 <= self.call_rate <= 1 and 0 <= self.hwe <= 1 and 0 < self.hits_cutoff <= 1):
            raise OptionError("maf, call_rate, hwe or hits_cutoff is out of range")
        return self


@dataclass(frozen=True)
class WorkerOptions:
    ped: str = ""
    dat: str = ""
    vcf: str | None = None
    dosage: bool = False
    binary: bool = False
    prefix: str = ""
    ld_window: int = 1_000_000
    zip: bool = False
    thin: bool = False
    label_hits: bool = False
    vc_x: bool = False
    separate_x: bool = False
    make_residuals: bool = False
    inverse_normal: bool = False
    trait_name: str | None = None
    recessive: bool = False
    dominant: bool = False
    kin_pedigree: bool = False
    kin_geno: bool = False
    kin_file: str | None = None
    kinx_file: str | None = None
    kin_save: bool = False
    kin_maf: float = 0.05
    kin_miss: float = 0.05
    kin_least: float = 0.0
    x_label: str = "X"
    x_start: int = 2_699_520
    x_end: int = 154_931_044
    male_label: int = 1
    female_label: int = 2
    cpu: int = 1
    kin_only: bool = False
    gene_map: str | None = None
    merged_vcf_id: bool = False
    use_covariates: bool = True
    range: str | None = None
    variant_list: str | None = None
    split_uv: bool = False
    new_format: bool = False
    print_case_ac: bool = False
    debug: bool = False

    def checked(self) -> WorkerOptions:
        if not (self.ped and self.dat):
            raise OptionError("a pedigree and its data file are needed")
        if self.make_residuals and self.binary:
            raise OptionError("make_residuals excludes binary")
        if self.print_case_ac and (not self.trait_name or "/" in self.trait_name):
            raise OptionError("print_case_ac needs a single trait")
        if sum((self.kin_pedigree, self.kin_geno, bool(self.kin_file))) > 1:
            raise OptionError("one source of kinship at most")
        if (self.vc_x or self.separate_x) and not (self.kin_pedigree or self.kin_geno or self.kin_file):
            raise OptionError("a variance component of the X needs kinship")
        if self.kin_file and (self.vc_x or self.separate_x) and not self.kinx_file:
            raise OptionError("a kinship file needs kinx_file for the X")
        if self.kinx_file and not self.kin_file:
            raise OptionError("kinx_file goes with kin_file")
        if (self.kin_save or self.kin_only) and not (self.kin_geno and self.prefix):
            raise OptionError("kin_save and kin_only need kin_geno, whose matrix they write, and a prefix")
        unheeded = [n for n in ("zip", "thin", "label_hits", "gene_map", "split_uv", "new_format", "debug") if getattr(self, n)]
        if unheeded or self.cpu != 1:
            raise OptionError(f"not rebuilt: {', '.join(unheeded) or 'cpu'} (compression, plots and threads are the cluster's and the caller's)")
        if self.recessive and self.dominant:
            raise OptionError("recessive and dominant exclude each other")
        if self.x_start > self.x_end or self.male_label == self.female_label or self.ld_window < 0:
            raise OptionError("the X's bounds, the labels of the sexes or the window make no sense")
        return self
