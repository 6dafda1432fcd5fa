"""Record domains and the schemas of the evidence tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The value of a field that an article doesn't give. Record columns hold it, never null.
MISSING = "NOT_DETECTED"


@dataclass(frozen=True)
class Domain:
    """A record type: ordered columns, which of them hold numbers or SMILES, and allowed values."""

    key: str
    title: str
    columns: tuple[str, ...]
    numeric: frozenset[str]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    aliases: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def smiles(self) -> tuple[str, ...]:
        """The columns that hold structures: named SMILES, alone or with the component they are of."""
        return tuple(c for c in self.columns if c.lower() == "smiles" or c.startswith("SMILES_") and c != "SMILES_type")

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c, StringType(), False) for c in self.columns])


_RELATION = {"target_relation": ("=", "<", ">")}
_MOLECULE = ("compound_id", "smiles", "target_type", "target_relation", "target_value", "target_units", "bacteria")

# Names, order, kinds, allowed values and aliases of record columns are the exchange
# format of predictions and truth tables.
_ALL: tuple[Domain, ...] = (
    Domain(
        "benzimidazole", "Benzimidazoles", _MOLECULE,
        frozenset({"target_value"}), enums=_RELATION,
    ),
    Domain(
        "oxazolidinone", "Oxazolidinones", _MOLECULE,
        frozenset({"target_value"}), enums=_RELATION,
    ),
    Domain(
        "cocrystals", "Co-crystals", (
            "name_cocrystal", "ratio_cocrystal", "name_drug", "SMILES_drug", "name_coformer", "SMILES_coformer", "photostability_change",
        ),
        frozenset({}), enums={"photostability_change": ("decrease", "does not change", "increase")},
    ),
    Domain(
        "eyedrops", "EyeDrops", (
            "smiles", "name", "perm (cm/s)", "logP",
        ),
        frozenset({"perm (cm/s)", "logP"}), aliases={
            "SMILES": "smiles", "compound": "name", "compound_name": "name", "drug": "name", "permeability": "perm (cm/s)", "perm": "perm (cm/s)", "perm_cm_s": "perm (cm/s)", "corneal_permeability": "perm (cm/s)", "log_p": "logP", "logp": "logP",
        },
    ),
    Domain(
        "complexes", "Complexes", (
            "compound_id", "compound_name", "SMILES", "SMILES_type", "target",
        ),
        frozenset({"target"}), enums={"SMILES_type": ("ligand", "environment")}, aliases={
            "target_value": "target",
        },
    ),
    Domain(
        "nanozymes", "Nanozymes", (
            "formula", "activity", "syngony", "length", "width", "depth", "surface", "km_value", "km_unit", "vmax_value", "vmax_unit", "reaction_type", "c_min",
            "c_max", "c_const", "c_const_unit", "ccat_value", "ccat_unit", "ph", "temperature",
        ),
        frozenset({
            "length", "width", "depth", "km_value", "vmax_value", "c_min", "c_max", "c_const", "ccat_value", "ph", "temperature",
        }),
    ),
    Domain(
        "magnetic", "Nanomag", (
            "name", "np_core", "np_shell", "core_shell_formula", "np_shell_2", "np_hydro_size", "xrd_scherrer_size", "emic_size", "space_group_core",
            "space_group_shell", "squid_sat_mag", "squid_rem_mag", "exchange_bias_shift_Oe", "vertical_loop_shift_M_vsl_emu_g", "hc_kOe", "squid_h_max",
            "zfc_h_meas", "instrument", "fc_field_T", "squid_temperature", "coercivity", "htherm_sar", "mri_r1", "mri_r2",
        ),
        frozenset({
            "np_hydro_size", "xrd_scherrer_size", "emic_size", "squid_sat_mag", "squid_rem_mag", "exchange_bias_shift_Oe", "vertical_loop_shift_M_vsl_emu_g",
            "hc_kOe", "squid_h_max", "zfc_h_meas", "fc_field_T", "squid_temperature", "coercivity", "htherm_sar", "mri_r1", "mri_r2",
        }),
    ),
    Domain(
        "cytotoxicity", "Cytotox", (
            "material", "shape", "coat_functional_group", "synthesis_method", "surface_charge", "core_nm", "size_in_medium_nm", "hydrodynamic_nm",
            "potential_mv", "zeta_in_medium_mv", "no_of_cells_cells_well", "human_animal", "cell_source", "cell_tissue", "cell_morphology", "cell_age",
            "time_hr", "concentration", "test", "test_indicator", "viability_%",
        ),
        frozenset({
            "core_nm", "size_in_medium_nm", "hydrodynamic_nm", "potential_mv", "zeta_in_medium_mv", "no_of_cells_cells_well", "time_hr", "concentration",
            "viability_%",
        }), enums={"surface_charge": ("Negative", "Neutral", "Positive"), "human_animal": ("H", "A")},
    ),
    Domain(
        "seltox", "SelTox", (
            "np", "coating", "bacteria", "mdr", "strain", "np_synthesis", "method", "mic_np_µg_ml", "concentration", "zoi_np_mm", "np_size_min_nm",
            "np_size_max_nm", "np_size_avg_nm", "shape", "time_set_hours", "zeta_potential_mV", "solvent_for_extract", "temperature_for_extract_C",
            "duration_preparing_extract_min", "precursor_of_np", "concentration_of_precursor_mM", "hydrodynamic_diameter_nm", "ph_during_synthesis",
        ),
        frozenset({
            "mdr", "mic_np_µg_ml", "concentration", "zoi_np_mm", "np_size_min_nm", "np_size_max_nm", "np_size_avg_nm", "time_set_hours", "zeta_potential_mV",
            "temperature_for_extract_C", "duration_preparing_extract_min", "concentration_of_precursor_mM", "hydrodynamic_diameter_nm", "ph_during_synthesis",
        }), enums={"mdr": ("0", "1")},
    ),
    Domain(
        "synergy", "Synergy", (
            "NP", "bacteria", "strain", "NP_synthesis", "drug", "drug_dose_µg_disk", "NP_concentration_µg_ml", "NP_size_min_nm", "NP_size_max_nm",
            "NP_size_avg_nm", "shape", "method", "ZOI_drug_mm_or_MIC _µg_ml", "error_ZOI_drug_mm_or_MIC_µg_ml", "ZOI_NP_mm_or_MIC_np_µg_ml",
            "error_ZOI_NP_mm_or_MIC_np_µg_ml", "ZOI_drug_NP_mm_or_MIC_drug_NP_µg_ml", "error_ZOI_drug_NP_mm_or_MIC_drug_NP_µg_ml",
            "fold_increase_in_antibacterial_activity", "zeta_potential_mV", "MDR", "FIC", "effect", "time_hr", "coating_with_antimicrobial_peptide_polymers",
            "combined_MIC", "peptide_MIC", "viability_%", "viability_error",
        ),
        frozenset({
            "drug_dose_µg_disk", "NP_concentration_µg_ml", "NP_size_min_nm", "NP_size_max_nm", "NP_size_avg_nm", "ZOI_drug_mm_or_MIC _µg_ml",
            "error_ZOI_drug_mm_or_MIC_µg_ml", "ZOI_NP_mm_or_MIC_np_µg_ml", "error_ZOI_NP_mm_or_MIC_np_µg_ml", "ZOI_drug_NP_mm_or_MIC_drug_NP_µg_ml",
            "error_ZOI_drug_NP_mm_or_MIC_drug_NP_µg_ml", "fold_increase_in_antibacterial_activity", "zeta_potential_mV", "FIC", "time_hr", "combined_MIC",
            "peptide_MIC", "viability_%", "viability_error",
        }), aliases={
            "Bacteria": "bacteria", "ZOI_drug_mm_or_MIC_µg_ml": "ZOI_drug_mm_or_MIC _µg_ml", "ZOI_drug_mm_or_MIC_µg_m": "ZOI_drug_mm_or_MIC _µg_ml",
        },
    ),
)
DOMAINS: dict[str, Domain] = {d.key: d for d in _ALL}


def domain(key: str) -> Domain:
    if key not in DOMAINS:
        raise ValueError(f"no domain {key!r}; there are {', '.join(sorted(DOMAINS))}")
    return DOMAINS[key]


def shaped(table: str, df: DataFrame) -> DataFrame:
    """The columns of an evidence table in order, null where df has none."""
    have = lambda f: F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
    return df.select(*(have(f).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])))


def registry(spark: SparkSession) -> DataFrame:
    """A row a column of each domain."""
    rows = [(d.key, d.title, i, c, c in d.numeric, c in d.smiles, list(d.enums.get(c, ()))) for d in DOMAINS.values() for i, c in enumerate(d.columns)]
    return spark.createDataFrame(rows, "domain string, title string, ordinal int, field string, is_numeric boolean, is_smiles boolean, allowed array<string>")


_PLACE = "doc_id string, file_id string, page_number int"

#: The evidence store: one table each, partitioned by doc_id.
TABLES: dict[str, str] = {
    "documents": "doc_id string, source_path string, sha256 string, created_at timestamp",
    "files": "file_id string, doc_id string, kind string, path string, sha256 string, mime_type string",
    "pages": f"page_id string, {_PLACE}, width double, height double, text string",
    "evidence_blocks": f"evidence_id string, {_PLACE}, source_type string, section string, title string, caption string, text string, bbox array<double>, metadata string, parser string, confidence double",
    "tables": f"table_id string, {_PLACE}, label string, caption string, columns array<string>, bbox array<double>, parser string, confidence double",
    "table_rows": "row_id string, doc_id string, table_id string, evidence_id string, row_index int, cells array<string>, normalized_text string",
    "figures": f"figure_id string, {_PLACE}, label string, caption string, image_path string, bbox array<double>, kind string, ocr_text string, parser string, confidence double",
    "visual_tasks": f"task_id string, {_PLACE}, task_type string, target_type string, target_id string, provider_hint string, priority int, reason string, status string, payload string, created_at timestamp",
    "ocr_blocks": f"ocr_id string, task_id string, {_PLACE}, text string, bbox array<double>, provider string, confidence double, metadata string",
    "structure_detections": f"detection_id string, task_id string, {_PLACE}, parent_figure_id string, image_path string, bbox array<double>, label_nearby string, smiles string, provider string, confidence double, metadata string",
    "diagnostics": "doc_id string, pages_count int, evidence_count int, tables_count int, table_rows_count int, figures_count int, notes array<string>",
    "agent_table_measurements": f"record_id string, {_PLACE}, table_id string, evidence_id string, compound_id string, target_type string, target_relation string, target_value string, target_units string, bacteria string, raw_text string, confidence double",
    "agent_compound_links": f"link_id string, {_PLACE}, compound_id string, measurement_record_id string, smiles_evidence_id string, smiles string, canonical_smiles string, bacteria string, target_type string, target_value string, target_units string, confidence double, status string, issues array<string>",
    "agent_conflict_decisions": f"decision_id string, {_PLACE}, compound_id string, decision string, reason string, canonical struct<compound_id:string,smiles:string,target_type:string,target_value:string,target_units:string,bacteria:string,source_link_id:string,issues:array<string>>, confidence double",
    "agent_scaffold_resolutions": f"scaffold_id string, {_PLACE}, source_evidence_id string, status string, compound_range string, variable_sites array<string>, reason string",
}
