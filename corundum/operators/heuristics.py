"""Records straight from text, table rows or model answers, without a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.core import let
from corundum.functions.text import compact, dois
from corundum.functions.values import confidence, is_missing, strip

# Patterns of stated properties in the order they are tried, of structures and
# materials, words that only look like structures, and columns that hold a record's parts.
PROPERTIES = (
    r"\bMIC\s*(?:=|of|:)?\s*[<>~]?\s*\d+(?:\.\d+)?\s*(?:ug/mL|µg/mL|mg/L|mM|uM|µM)\b",
    r"\bpMIC\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\b",
    r"\b(?:IC50|EC50|CC50|LC50)\s*(?:=|of|:)?\s*[<>~]?\s*\d+(?:\.\d+)?\s*(?:nM|uM|µM|mM|ug/mL|µg/mL)\b",
    r"\b(?:size|diameter)\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\s*(?:nm|µm|um)\b",
    r"\b(?:zeta potential)\s*(?:=|of|:)?\s*-?\d+(?:\.\d+)?\s*mV\b",
    r"\b(?:viability|cell viability)\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\s*%\b",
    r"\bKm\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\s*(?:mM|uM|µM)\b",
    r"\bVmax\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\s*[A-Za-z0-9/(). -]+\b",
    r"\bsolubility\s*(?:=|of|:)?\s*\d+(?:\.\d+)?\s*(?:mg/mL|ug/mL|µg/mL|mM)\b",
)
SMILES_TOKEN = r"\b[A-ZBCNOFPSIbcnops0-9@+\-\[\]\(\)=#$\\/%.]{6,}\b"
NOT_SMILES = ("RESULTS", "METHODS", "SUPPORT", "ACTIVITY", "COMPOUND", "FIGURE")
MATERIAL = r"(?i)\b(?:AgNPs?|AuNPs?|Fe3O4|TiO2|ZnO|SiO2|CeO2|magnetic nanoparticles?|silver nanoparticles?)\b"
ROW_PRIMARY = ("smiles", "SMILES", "compound", "Compound", "material", "Material", "nanoparticle")
ROW_PROPERTY = ("activity", "Activity", "MIC", "pMIC", "size", "Size", "viability", "solubility")
ROW_EVIDENCE = ("doi", "DOI", "source", "section", "page", "Source")
MODEL_PRIMARY = ("primary_value", "smiles", "SMILES", "compound", "compound_name", "molecule", "material", "nanoparticle", "name")
MODEL_PROPERTY = ("property", "activity", "measurement", "target", "target_value", "value", "result")
MODEL_EVIDENCE = ("evidence", "source", "quote", "rationale", "page", "section")
SAMPLE_PRIMARY = ("smiles", "SMILES", "SMILES_drug", "SMILES_coformer", "compound_name", "compound_id", "name_cocrystal", "name_drug", "formula", "material", "name", "np", "NP", "np_core")
SAMPLE_SKIP = ("compound_id", "compound_name", "name", "smiles", "SMILES", "SMILES_type", "SMILES_drug", "SMILES_coformer", "material", "formula", "np", "NP")

FOUND = "array<struct<value:string,evidence:string>>"


def properties(c: Column) -> Column:
    """value, evidence (80 characters before, 120 after) and confidence of every stated property,
    pattern by pattern. Offsets are summed from matches and gaps."""

    def of(pattern: str) -> Column:
        p = "(?iuU)" + pattern

        def found(m: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(m["whole"], 1, i), F.lit(0), lambda a, x: a + F.length(x))
                start = before + F.aggregate(F.slice(m["gaps"], 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
                left = F.greatest(start - 80, F.lit(0))
                near = F.substring(c, left + 1, start - left + F.length(w) + 120)
                return F.struct(compact(w).alias("value"), compact(near).alias("evidence"))

            return F.transform(m["whole"], one)

        parts = F.struct(F.regexp_extract_all(c, F.lit(p), F.lit(0)).alias("whole"), F.split(c, p, -1).alias("gaps"))
        return F.when(c.rlike(p), let(parts, found)).otherwise(F.array().cast(FOUND))

    every = F.concat(*map(of, PROPERTIES))
    return F.transform(every, lambda x, i: F.struct(x["value"].alias("value"), x["evidence"].alias("evidence"), (0.78 + F.least(F.lit(0.16), i * 0.01)).alias("confidence")))


def smiles_tokens(c: Column, limit: int = 20) -> Column:
    """The first distinct tokens that could be structures: of the right letters, with a bond or
    bracket or two digits."""
    tokens = F.regexp_extract_all(c, F.lit(SMILES_TOKEN), F.lit(0))
    likely = F.filter(tokens, lambda t: ~F.upper(t).isin(*NOT_SMILES) & (t.rlike(r"[=#\[\]()/\\]") | t.rlike(r"\d.*\d")))
    return F.slice(F.array_distinct(likely), 1, limit)


def materials(c: Column, limit: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(MATERIAL), F.lit(0))), 1, limit)


def source_summary(docs: DataFrame, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """by, text_tokens, detected_dois (five, sorted), detected_properties, detected_smiles."""
    c = F.coalesce(F.col(text), F.lit(""))
    tokens = F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(compact(c), " ")))
    return docs.select(by, tokens.alias("text_tokens"), F.slice(F.array_sort(F.array_distinct(dois(c))), 1, 5).alias("detected_dois"), F.size(properties(c)).alias("detected_properties"), F.size(smiles_tokens(c)).alias("detected_smiles"))


def records_from_text(docs: DataFrame, *, nano: bool, text: str = "text", by: str = "doc_id", limit: int = 24) -> DataFrame:
    """A record for each of the first properties of a text, paired in turn with the structures (or
    materials) that it names."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(by, F.slice(properties(c), 1, limit).alias("p"), (materials(c) if nano else smiles_tokens(c)).alias("objects"), F.get(dois(c), F.lit(0)).alias("doi"))
    rows = found.select(by, "objects", "doi", F.posexplode("p").alias("i", "p"))
    n = F.size("objects")
    primary = F.when(n > 0, F.get("objects", F.pmod("i", F.greatest(n, F.lit(1))))).otherwise(F.lit("nanomaterial" if nano else "chemical object"))
    return rows.select(by, F.format_string(("nano" if nano else "mol") + "-%03d", F.col("i") + 1).alias("object_id"), primary.alias("primary_value"), F.col("p.value").alias("property"), F.coalesce("doi", F.left("p.evidence", F.lit(96))).alias("evidence"), F.format_string("%.2f", "p.confidence").alias("confidence"))


def first_present(row: Column, names: tuple[str, ...]) -> Column:
    """Of a map the first value of these keys that isn't empty, else the first of any key."""
    full = lambda x: F.nullif(x, F.lit(""))
    any_value = F.get(F.filter(F.map_values(row), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return F.coalesce(*(full(F.try_element_at(row, F.lit(n))) for n in names), any_value, F.lit(""))


def records_from_rows(rows: DataFrame, *, row: str = "row", nth: str = "nth", by: str = "doc_id", limit: int = 80) -> DataFrame:
    """A record a table row; row is a map of header to value, nth counts from 1."""
    r, i = F.col(row), F.col(nth)
    primary, prop, evidence = (first_present(r, n) for n in (ROW_PRIMARY, ROW_PROPERTY, ROW_EVIDENCE))
    own = F.coalesce(F.nullif(F.try_element_at(r, F.lit("object_id")), F.lit("")), F.nullif(F.try_element_at(r, F.lit("compound_id")), F.lit("")), F.format_string("obj-%03d", i))
    blank = lambda x, other: F.when(x == "", F.lit(other)).otherwise(x)
    return rows.where(i <= limit).select(by, own.alias("object_id"), blank(primary, "not detected").alias("primary_value"), blank(prop, "schema field pending").alias("property"), blank(evidence, "uploaded table").alias("evidence"), F.format_string("%.2f", F.least(F.lit(0.98), 0.72 + i * 0.01)).alias("confidence"))


def records_from_model(answers: DataFrame, *, answer: str = "answer", by: str = "doc_id", limit: int = 80) -> DataFrame:
    """Records of a model's JSON answer: a list, or an object with records, data or items, or one
    record. Keys have synonyms; values are cut to fixed lengths."""
    v = F.try_parse_json(F.col(answer))
    at = lambda path: F.try_variant_get("v", path, "array<variant>")
    raw = F.coalesce(*(F.when(F.size(at(p)) > 0, at(p)) for p in ("$.records", "$.data", "$.items")), at("$"), F.array("v"))
    items = answers.select(by, v.alias("v")).where("v is not null").select(by, F.posexplode(F.slice(raw, 1, limit)).alias("i", "item"))
    items = items.withColumn("row", F.from_json(F.to_json("item"), "map<string,string>")).where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    full = lambda x: F.nullif(x, F.lit(""))
    primary, prop, evidence = (full(first_present(F.col("row"), n)) for n in (MODEL_PRIMARY, MODEL_PROPERTY, MODEL_EVIDENCE))
    own = F.coalesce(full(F.try_element_at("row", F.lit("object_id"))), full(F.try_element_at("row", F.lit("id"))), F.format_string("llm-%03d", F.col("i") + 1))
    cut = lambda x, n: F.left(x, F.lit(n))
    kept = items.where(primary.isNotNull() | prop.isNotNull())
    return kept.select(by, cut(own, 80).alias("object_id"), cut(F.coalesce(primary, F.lit("not detected")), 500).alias("primary_value"), cut(F.coalesce(prop, F.lit("schema field pending")), 500).alias("property"), cut(F.coalesce(evidence, F.lit("LLM extraction")), 500).alias("evidence"), F.format_string("%.2f", confidence(F.try_element_at("row", F.lit("confidence")))).alias("confidence"))


def records_from_samples(samples: DataFrame, columns: tuple[str, ...], *, by: str = "pdf") -> DataFrame:
    """Domain samples as records: the first naming field, and up to eight other fields."""
    c = lambda n: F.col(f"`{n}`").cast("string")
    given = lambda n: F.when(~is_missing(c(n)), c(n))
    have = [n for n in (*SAMPLE_PRIMARY, *columns) if n in samples.columns]
    primary = F.coalesce(*map(given, have))
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{n}="), given(n)) for n in columns if n not in SAMPLE_SKIP)))
    own = F.coalesce(*(given(n) for n in ("compound_id", "name", "np", "NP") if n in samples.columns), F.lit("full"))
    return samples.where(primary.isNotNull()).select(by, F.left(own, F.lit(80)).alias("object_id"), F.left(primary, F.lit(500)).alias("primary_value"), F.left(F.array_join(F.slice(parts, 1, 8), "; "), F.lit(500)).alias("property"))


def heuristic_score(baseline: Column, mean_confidence: Column, records: Column, text_tokens: Column) -> Column:
    """A guess without truth, from confidence and coverage. It isn't a measurement."""
    base = F.coalesce(baseline, F.lit(0.22)) + F.coalesce(mean_confidence, F.lit(0.35)) * 0.12 + F.least(F.lit(1.0), records / 12) * 0.08 + F.least(F.lit(0.12), text_tokens / 10000)
    return F.round(F.least(F.lit(0.88), F.greatest(F.lit(0.05), base)), 3)
