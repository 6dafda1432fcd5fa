"""Rank evidence for a record type, choose what a model sees, and judge how ready a document is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.core import let, once
from corundum.functions.text import snippet
from corundum.schemas import Domain

# What counts as a number or a term of chemistry, worth of sources and weights. U: a letter
# beyond ASCII is part of a word, which Java's own mark of a word's end leaves to its version.
NUMBER = r"(?<![A-Za-z])(?:[<>]=?|=)?\s*\d+(?:[.,]\d+)?(?:\s*[-–]\s*\d+(?:[.,]\d+)?)?"
CHEMISTRY = r"(?iU)\b(?:SMILES|MIC|pMIC|IC50|EC50|AgNP|Fe3O4|TiO2|SiO2|ZnO|AuNP|DOTA|logK|lgK|Km|Vmax)\b"
MEASURE_TERMS = ("mic", "pmic", "mic50", "mic80", "ic50", "ec50", "fic", "km", "vmax")
SOURCE_WORTH = (("table_row", 1.25), ("table_caption", 0.75), ("figure_caption", 0.75), ("chemical_structure_smiles", 1.0), ("chemical_structure_image", 1.0))
# Other words for the fields of all record types. Those of further types come from a file
# (sources.prompts.read_aliases).
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "compound_id": ("compound", "molecule", "derivative", "ligand", "complex", "sample", "id"),
    "compound_name": ("compound", "name", "ligand", "complex", "material"),
    "name": ("name", "sample", "material", "nanoparticle"),
    "smiles": ("smiles", "structure", "chemical structure", "compound", "molecule"),
    "SMILES": ("smiles", "structure", "chemical structure", "ligand", "complex"),
    "SMILES_type": ("ligand", "environment", "complex"),
    "target_type": ("MIC", "pMIC", "IC50", "EC50", "activity", "measurement"),
    "target_relation": ("<", ">", "=", "less than", "greater than"),
    "target_value": ("MIC", "pMIC", "logK", "lgK", "IC50", "EC50", "activity", "value"),
    "target_units": ("ug/mL", "microg/mL", "mg/L", "mM", "uM", "units"),
    "bacteria": ("bacteria", "strain", "Staphylococcus", "aureus", "Escherichia", "coli", "E. coli", "S. aureus"),
    "strain": ("strain", "bacteria", "isolate"),
    "MDR": ("MDR", "multidrug", "resistant"),
    "mdr": ("MDR", "multidrug", "resistant"),
    "drug": ("drug", "antibiotic", "compound"),
    "FIC": ("FIC", "fractional inhibitory", "synergy"),
    "combined_MIC": ("combined MIC", "MIC", "combination"),
    "peptide_MIC": ("peptide MIC", "MIC", "peptide"),
    "effect": ("synergy", "additive", "antagonism", "effect"),
    "fold_increase_in_antibacterial_activity": ("fold", "increase", "antibacterial activity"),
    "viability_error": ("viability", "error", "standard deviation"),
    "activity": ("activity", "catalytic", "enzyme", "nanozyme"),
    "reaction_type": ("reaction", "substrate", "oxidase", "peroxidase", "catalase"),
    "km_value": ("Km", "Michaelis", "kinetic"),
    "km_unit": ("Km", "mM", "uM"),
    "vmax_value": ("Vmax", "kinetic", "velocity"),
    "vmax_unit": ("Vmax", "mM", "s-1", "min-1"),
    "ph": ("pH", "acidic", "basic"),
    "temperature": ("temperature", "C", "K"),
    "formula": ("formula", "composition", "material"),
    "surface": ("surface", "coating", "shell", "functional"),
    "shape": ("shape", "spherical", "rod", "cube"),
    "material": ("material", "nanoparticle", "composition"),
    "concentration": ("concentration", "dose", "mg/mL", "ug/mL", "mM"),
    "time_hr": ("time", "h", "hr", "hours"),
    "test": ("assay", "test", "method"),
    "test_indicator": ("indicator", "assay", "readout"),
    "cell_tissue": ("cell", "tissue", "line"),
    "cell_source": ("cell", "source", "line"),
    "cell_age": ("cell", "age"),
    "cell_morphology": ("morphology", "cell"),
    "human_animal": ("human", "animal", "mouse", "rat"),
    "no_of_cells_cells_well": ("cells/well", "cells per well", "seeding"),
    "core_nm": ("core", "nm", "diameter", "size"),
    "hydrodynamic_nm": ("hydrodynamic", "DLS", "nm", "diameter"),
    "size_in_medium_nm": ("medium", "size", "nm"),
    "potential_mv": ("potential", "mV", "zeta"),
    "zeta_in_medium_mv": ("zeta", "mV", "medium"),
    "surface_charge": ("surface charge", "zeta", "charge"),
    "coat_functional_group": ("coating", "functional group", "surface"),
    "synthesis_method": ("synthesis", "prepared", "method"),
    "np": ("nanoparticle", "NP", "AgNP"),
    "NP": ("nanoparticle", "NP"),
    "NP_synthesis": ("synthesis", "prepared", "NP"),
    "np_synthesis": ("synthesis", "prepared", "NP"),
    "NP_size_avg_nm": ("average size", "diameter", "nm", "TEM", "DLS"),
    "NP_size_min_nm": ("minimum size", "size range", "nm"),
    "NP_size_max_nm": ("maximum size", "size range", "nm"),
    "np_size_avg_nm": ("average size", "diameter", "nm", "TEM", "DLS"),
    "np_size_min_nm": ("minimum size", "size range", "nm"),
    "np_size_max_nm": ("maximum size", "size range", "nm"),
    "zeta_potential_mV": ("zeta", "potential", "mV"),
    "zoi_np_mm": ("zone of inhibition", "ZOI", "mm"),
    "coating": ("coating", "capped", "surface"),
    "method": ("method", "assay", "diffusion", "broth"),
    "precursor_of_np": ("precursor", "silver nitrate", "AgNO3"),
    "concentration_of_precursor_mM": ("precursor", "concentration", "mM"),
    "ph_during_synthesis": ("pH", "synthesis"),
    "temperature_for_extract_C": ("temperature", "extract", "C"),
    "duration_preparing_extract_min": ("duration", "extract", "min"),
    "solvent_for_extract": ("solvent", "extract"),
    "time_set_hours": ("time", "hours", "incubation"),
    "name_cocrystal": ("cocrystal", "co-crystal", "name"),
    "name_drug": ("drug", "API", "active pharmaceutical"),
    "name_coformer": ("coformer", "co-former"),
    "SMILES_drug": ("SMILES", "drug", "structure"),
    "SMILES_coformer": ("SMILES", "coformer", "structure"),
    "ratio_cocrystal": ("ratio", "stoichiometry", "cocrystal"),
    "photostability_change": ("photostability", "stability", "light"),
    "np_core": ("core", "magnetic", "nanoparticle"),
    "np_shell": ("shell", "coating", "surface"),
    "np_shell_2": ("shell", "coating", "surface"),
    "core_shell_formula": ("formula", "core", "shell"),
    "squid_sat_mag": ("saturation magnetization", "Ms", "emu/g"),
    "squid_rem_mag": ("remanent magnetization", "Mr", "emu/g"),
    "squid_temperature": ("SQUID", "temperature", "K"),
    "squid_h_max": ("SQUID", "field", "Oe", "T"),
    "coercivity": ("coercivity", "Hc", "Oe"),
    "hc_kOe": ("coercivity", "Hc", "kOe"),
    "exchange_bias_shift_Oe": ("exchange bias", "shift", "Oe"),
    "vertical_loop_shift_M_vsl_emu_g": ("vertical loop shift", "emu/g"),
    "fc_field_T": ("field cooled", "FC", "T"),
    "mri_r1": ("MRI", "r1", "relaxivity"),
    "mri_r2": ("MRI", "r2", "relaxivity"),
    "htherm_sar": ("SAR", "hyperthermia", "specific absorption"),
    "instrument": ("instrument", "SQUID", "VSM", "MRI"),
    "xrd_scherrer_size": ("XRD", "Scherrer", "size"),
    "space_group_core": ("space group", "core", "XRD"),
    "space_group_shell": ("space group", "shell", "XRD"),
    "np_hydro_size": ("hydrodynamic", "DLS", "size"),
    "emic_size": ("electron microscopy", "TEM", "SEM", "size"),
    "zfc_h_meas": ("ZFC", "field", "measurement"),
}


@dataclass(frozen=True)
class Skill:
    """What to look for: a name, the fields of its records, further terms, other words for fields."""

    name: str
    fields: tuple[str, ...]
    keywords: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)

    @staticmethod
    def of(d: Domain, keywords: tuple[str, ...] = (), aliases: dict[str, tuple[str, ...]] | None = None) -> Skill:
        return Skill(d.key, d.columns, keywords, FIELD_ALIASES if aliases is None else aliases)

    @property
    def needs_structure(self) -> bool:
        return any("smiles" in f.lower() for f in self.fields)

    @property
    def terms(self) -> tuple[str, ...]:
        return ordered_unique((*self.keywords, *(t for f in self.fields for t in self.terms_of(f))))

    def terms_of(self, name: str) -> tuple[str, ...]:
        return field_terms(name, self.aliases)


def ordered_unique(values: tuple[str, ...]) -> tuple[str, ...]:
    """Stripped, without empty ones and repeats in another case; the first of each stays."""
    return tuple({v.strip().lower(): v.strip() for v in reversed(values) if v.strip()}[k] for k in dict.fromkeys(v.strip().lower() for v in values if v.strip()))


def field_terms(name: str, aliases: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """A field's name, with spaces, its parts of two letters or more, and its aliases, those of its
    name in small letters too."""
    parts = tuple(p for p in re.split(r"[_\W]+", name) if len(p) > 1)
    known = aliases or {}
    return ordered_unique((name, name.replace("_", " "), *parts, *known.get(name, ()), *known.get(name.lower(), ())))


def _found(low: Column, term: str) -> Column:
    """Whether a term is in a lower-cased text: a word whole, anything else as part of the text. The
    plain search comes first: few texts get as far as the expression."""
    word = term.lower()
    there = F.contains(low, F.lit(word))
    return there & low.rlike(rf"(?U)(?<!\w)\Q{word}\E(?!\w)") if word.isalnum() else there


def matched(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms in the text, in their order."""
    listed = lambda low: F.array_compact(F.array(*(F.when(_found(low, t), F.lit(t)) for t in ordered_unique(terms)))).cast("array<string>")
    return let(F.lower(text), listed)


def score(text: Column, source: Column, confidence: Column, matches: Column) -> Column:
    """Terms matched and what the source, a number, a term of chemistry and confidence add."""
    worth = F.lit(0.0)
    for s, w in SOURCE_WORTH:
        worth = F.when(source == s, F.lit(w)).otherwise(worth)
    sure = F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(0.0), confidence - 0.5)), F.lit(0.0))
    total = F.size(matches) + worth + F.when(text.rlike(NUMBER), 0.5).otherwise(0.0) + F.when(text.rlike(CHEMISTRY), 0.7).otherwise(0.0) + sure
    return F.when(F.size(matches) > 0, total).otherwise(F.lit(0.0))


def candidates(evidence: DataFrame, skill: Skill, *, top: int = 20, by: str = "doc_id") -> DataFrame:
    """by, rank, score, evidence_id, page_number, source_type, matched_terms, snippet: the best top
    evidence of each document, equal scores by page and id. Scores are equal to six digits: their sums
    differ in the last bit by what was added."""
    c = F.col
    judged = let(matched(c("text"), skill.terms), lambda m: F.struct(m.alias("matches"), score(c("text"), c("source_type"), c("confidence"), m).alias("score")))
    scored = once(evidence, judged, "judged").where("judged.score > 0")
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.round("judged.score", 6).desc(), "page_number", "evidence_id"))
    best = scored.withColumn("rank", nth).where(c("rank") <= top)
    return best.select(by, "rank", F.round("judged.score", 3).alias("score"), "evidence_id", "page_number", "source_type", F.slice("judged.matches", 1, 12).alias("matched_terms"), snippet(c("text"), 520).alias("snippet"))


def select_balanced(found: DataFrame, limit: int, *, by: str = "doc_id") -> DataFrame:
    """At most limit candidates of each document: shares for running text, table rows (those that
    name a measure, if any does) and structures near the chosen pages, then the best of the rest."""
    c = F.col
    quota = max(1, limit // 3)
    text_quota = max(1, limit - 2 * quota)
    whole = Window.partitionBy(by)
    measures = F.exists("matched_terms", lambda t: F.lower(t).isin(*MEASURE_TERMS))
    is_row, is_smiles, is_image = (c("source_type") == s for s in ("table_row", "chemical_structure_smiles", "chemical_structure_image"))
    kind = F.when(is_image, "image").when(is_smiles, "structure").when(~is_row, "text").when(c("row_measures") | ~c("any_measures"), "row").otherwise("other")
    f = found.withColumn("row_measures", is_row & measures).withColumn("any_measures", F.max("row_measures").over(whole)).withColumn("kind", kind)
    f = f.withColumn("k", F.row_number().over(Window.partitionBy(by, "kind").orderBy("rank")))
    first = ((c("kind") == "text") & (c("k") <= text_quota)) | ((c("kind") == "row") & (c("k") <= quota))
    pages = F.collect_set(F.when(first, c("page_number"))).over(whole)  # limit pages at most
    f = f.withColumn("first", first).withColumn("pages", pages)
    far = F.array_min(F.transform("pages", lambda p: F.abs(p - c("page_number"))))
    near = F.when(F.size("pages") > 0, F.coalesce(far, F.lit(2147483647))).otherwise(F.lit(0))
    f = f.withColumn("s", F.row_number().over(Window.partitionBy(by, "kind").orderBy(near, "rank")))
    f = f.withColumn("chosen", c("first") | ((c("kind") == "structure") & (c("s") <= quota)))
    # The shares come first, then the rest by rank, until limit.
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("chosen"), "rank"))
    f = f.where(c("chosen") | ~is_image).withColumn("turn", turn).where(c("turn") <= limit)
    return f.select(*found.columns)


def field_coverage(evidence: DataFrame, skill: Skill, *, by: str = "doc_id") -> DataFrame:
    """by, field, hits, status: present from three pieces of evidence, partial from one."""
    c = F.col
    hits = let(F.lower("text"), lambda low: F.array(*(F.struct(F.lit(f).alias("field"), _any(low, skill.terms_of(f)).cast("int").alias("hit")) for f in skill.fields)))
    per = evidence.select(by, F.explode(hits).alias("h")).groupBy(by, c("h.field").alias("field")).agg(F.sum("h.hit").alias("hits"))
    return per.withColumn("status", F.when(c("hits") >= 3, "present").when(c("hits") > 0, "partial").otherwise("missing"))


def _any(low: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | _found(low, t)
    return F.coalesce(out, F.lit(False))


def field_examples(evidence: DataFrame, skill: Skill, *, most: int = 3, by: str = "doc_id") -> DataFrame:
    """by, field, nth, evidence_id, page_number, source_type, matched_terms, snippet: the first
    evidence of each field by page and id. Matches are exploded before texts are cut, and only the
    first of each field are kept."""
    c = F.col

    def of(name: str) -> Column:
        return let(matched(c("text"), skill.terms_of(name)), lambda m: F.when(F.size(m) > 0, F.struct(F.lit(name).alias("field"), F.slice(m, 1, 8).alias("terms"))))

    fields = F.array_compact(F.array(*map(of, skill.fields)))
    found = evidence.select(by, "evidence_id", "page_number", "source_type", "text", F.explode(fields).alias("f"))
    nth = F.row_number().over(Window.partitionBy(by, "f.field").orderBy("page_number", "evidence_id"))
    return found.withColumn("nth", nth).where(c("nth") <= most).select(by, "f.field", "nth", "evidence_id", "page_number", "source_type", c("f.terms").alias("matched_terms"), snippet(c("text")).alias("snippet"))


def skill_check(evidence: DataFrame, skill: Skill, structures: DataFrame, *, top: int = 20, by: str = "doc_id") -> DataFrame:
    """by, coverage, best, score, status. structures: by, smiles, detections, visual_tasks counts."""
    c = F.col
    coverage = field_coverage(evidence, skill, by=by).groupBy(by).agg(F.round(F.avg(F.when(c("status") == "present", 1.0).when(c("status") == "partial", 0.5).otherwise(0.0)), 3).alias("coverage"))
    best = candidates(evidence, skill, top=top, by=by).groupBy(by).agg(F.max("score").alias("best"))
    joined = coverage.join(best, by, "left").join(structures, by, "left").na.fill(0, ["smiles", "detections", "visual_tasks"])
    return _judged(joined, F.lit(skill.needs_structure)).select(by, "coverage", "best", "score", "status")


def _judged(joined: DataFrame, needs_structure: Column) -> DataFrame:
    """joined (coverage, best, smiles, detections, visual_tasks) with score and status."""
    c = F.col
    structure = F.when(~needs_structure, 1.0).when(c("smiles") > 0, 1.0).when(c("detections") > 0, 0.55).when(c("visual_tasks") > 0, 0.35).otherwise(0.15)
    candidate = F.round(F.least(F.lit(1.0), F.log1p(F.coalesce("best", F.lit(0.0))) / 3), 3)
    joined = joined.withColumn("score", F.round(c("coverage") * 0.62 + candidate * 0.26 + structure * 0.12, 3))
    status = F.when(c("best").isNull(), "low_signal").when(needs_structure & (c("smiles") == 0), "needs_visual_or_ocsr")
    status = status.when((c("score") >= 0.68) & (c("coverage") >= 0.55), "ready_for_single_agent_review").when(c("score") >= 0.42, "partial_evidence").otherwise("low_signal")
    return joined.withColumn("status", status)


def check_all(evidence: DataFrame, skills: list[Skill], structures: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """by, skill and what skill_check() says of each skill, in one pass over the evidence: a text is cut
    into words once, the terms of all skills are looked for among them, and the sums of all skills are
    made in one grouping. The terms are part of the plan: skills are settings, not data."""
    c = F.col
    terms = ordered_unique(tuple(t for s in skills for t in (*s.terms, *(t for f in s.fields for t in s.terms_of(f)))))
    low_terms = [t.lower() for t in terms]
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    words = listed([t for t in low_terms if t.isalnum()])
    pieces = listed([t for t in low_terms if not t.isalnum()])

    def found(low: Column) -> Column:
        tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)))
        return F.concat(F.array_intersect(tokens, words), F.filter(pieces, lambda t: F.contains(low, t)))

    def of_skill(s: Skill, m: Column) -> Column:
        hits = F.array(*(F.arrays_overlap(m, listed([t.lower() for t in s.terms_of(f)])).cast("int") for f in s.fields)).cast("array<int>")
        return F.struct(F.lit(s.name).alias("skill"), F.size(F.array_intersect(m, listed([t.lower() for t in s.terms]))).alias("n"), hits.alias("hits"))

    worth = F.lit(0.0)
    for source, w in SOURCE_WORTH:
        worth = F.when(c("source_type") == source, F.lit(w)).otherwise(worth)
    sure = F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(0.0), c("confidence") - 0.5)), F.lit(0.0))
    told = let(F.lower(F.coalesce("text", F.lit(""))), lambda low: let(found(low), lambda m: F.array(*(of_skill(s, m) for s in skills))))
    extra = worth + F.when(c("text").rlike(NUMBER), 0.5).otherwise(0.0) + F.when(c("text").rlike(CHEMISTRY), 0.7).otherwise(0.0) + sure
    rows = evidence.select(by, extra.alias("extra"), F.explode(told).alias("t"))
    width = max(len(s.fields) for s in skills)
    value = F.when(c("t.n") > 0, c("t.n") + c("extra"))
    sums = rows.groupBy(by, c("t.skill").alias("skill")).agg(F.round(F.max(value), 3).alias("best"), F.array(*(F.sum(F.get("t.hits", F.lit(i))) for i in range(width))).alias("sums"))
    sizes = F.create_map(*(F.lit(x) for s in skills for x in (s.name, len(s.fields))))
    shares = F.transform(F.filter("sums", lambda n: n.isNotNull()), lambda n: F.when(n >= 3, 1.0).when(n > 0, 0.5).otherwise(0.0))
    covered = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.element_at(sizes, c("skill"))
    joined = sums.withColumn("coverage", F.round(covered, 3)).join(structures, by, "left").na.fill(0, ["smiles", "detections", "visual_tasks"])
    needs = c("skill").isin(*(s.name for s in skills if s.needs_structure))
    return _judged(joined, needs).select(by, "skill", "coverage", "best", "score", "status")


def variant_score(evidence: DataFrame, keywords: tuple[str, ...], *, by: str = "doc_id") -> DataFrame:
    """by, score, hits of a prompt variant: log1p of the scores' sum over its first 48 terms."""
    c = F.col
    s = let(matched(c("text"), keywords[:48]), lambda m: score(c("text"), c("source_type"), c("confidence"), m))
    return evidence.select(by, s.alias("s")).groupBy(by).agg(F.round(F.log1p(F.sum("s")), 3).alias("score"), F.count_if(c("s") > 0).alias("hits"))
