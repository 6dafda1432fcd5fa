"""Column functions that find measurements, units, compounds and organisms in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corundum.functions.core import let, present
from corundum.functions.values import replaced, strip

# The patterns that say what counts as a target, a value with its unit, a compound id
# or an organism, and the order in which organisms are tried.
UNIT = r"µg\s*mL[−-]1|μg\s*mL[−-]1|ug\s*mL[−-]1|µmol\s*mL[−-]1|μmol\s*mL[−-]1|umol\s*mL[−-]1|µg/mL|μg/mL|ug/mL|mg/L|mg\s*L[−-]1|mM|µM|μM|uM|nM|mm"
TARGET = r"(?iuU)\b(MIC|pMIC|MIC50|MIC80|IC50|EC50|FIC|lgK|logK|Km|Vmax)\b"
ZONE = r"(?iuU)\b(?:inhibition\s+zone|zone\s+diameters?|agar\s+diffusion)\b"
VALUE = rf"(?iuU)(<=|>=|=|<|>)?\s*(\d+(?:[\.,]\d+)?)\s*((?:{UNIT}))?"
ONE_NUMBER = r"(?iuU)\A\D*?(?:(<=|>=|=|<|>)\s*)?(?<!\p{L})(\d+(?:[.,]\d+)?)(?!\p{L})(?:\s*(µg/mL|μg/mL|ug/mL|mg/L|mM|µM|μM|uM|nM|mm))?\D*\z"
BARE_VALUE = r"(?iuU)\A\s*(?:<=|>=|=|<|>)?\s*\d+(?:[\.,]\d+)?\s*\z"
UNIT_IN_BRACKETS = rf"(?iuU)\(({UNIT})\)"
COMPOUND = r"\b(?:compound|cmpd|compd)?\s*([A-Za-z]?\d+[A-Za-z]?(?:[-.][A-Za-z0-9]+)?)\b"
COMPOUND_COLUMN = r"(?iuU)\b(?:compounds?|hybrids?|samples?|entries|entry|no\.?|id)\b"
NO_VALUE = r"(?iuU)\A\s*(?:-|--|n\.?d\.?|not\s+detected|na|n/a)?\s*\z"
COMPOUND_RANGE = r"(?uU)\b([A-Za-z]?\d+[A-Za-z]?)\s*[-–]\s*([A-Za-z]?\d+[A-Za-z]?)\b"
SMILES_KEY = r"(?iuU)(?:canonical_smiles|smiles)\s*[=:]\s*([^|\s]+)"
COMPOUND_KEY = r"(?iuU)compound_id\s*[=:]\s*([^|\s]+)"
SCAFFOLD = r"(?iuU)\b(scaffold|substituent|R\d+|R-group|R group)\b"
VARIABLE_SITE = r"(?uU)\bR\d?\b"
SMILES_MARK = "Chemical structure SMILES:"
ORGANISMS = (
    ("Staphylococcus aureus", r"S\.?\s*aureus|Staphylococcus\s+aureus"),
    ("Escherichia coli", r"E\.?\s*coli|Escherichia\s+coli"),
    ("Pseudomonas aeruginosa", r"P\.?\s*aeruginosa|Pseudomonas\s+aeruginosa"),
    ("Bacillus subtilis", r"B\.?\s*subtilis|Bacillus\s+subtilis"),
    ("Enterococcus faecalis", r"E\.?\s*faecalis|Enterococcus\s+faecalis"),
    ("Salmonella typhosa", r"S\.?\s*typhosa|Salmonella\s+typhosa"),
    ("Staphylococcus epidermidis", r"S\.?\s*epiderm(?:idis|itis)|Staphylococcus\s+epiderm(?:idis|itis)"),
    ("Aspergillus niger", r"A\.?\s*niger|Aspergillus\s+niger"),
    ("Candida albicans", r"C\.?\s*albicans|Candida\s+albicans"),
)
#: Of each organism's pattern; a text without one of them names none.
EPITHET = r"(?iu)aureus|coli|aeruginosa|subtilis|faecalis|typhosa|epiderm|niger|albicans"
SAME_UNIT = (("ug", "µg"), ("umol", "µmol"), ("μ", "µ"), ("mL-1", "mL−1"))
DEFAULT_UNIT = {"INHIBITION_ZONE": "mm"}

MEASURED = "struct<relation:string,value:string,units:string>"


def _or_null(c: Column) -> Column:
    """nullif() with c computed once: where only some rows need it, nullif() holds its text twice."""
    return let(c, lambda x: F.when(x != "", x))


def no_value(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(NO_VALUE)


def unit(c: Column) -> Column:
    """The common form of a unit; null for an empty one."""
    return _or_null(replaced(strip(c), SAME_UNIT))


def default_unit(target: Column) -> Column:
    out = F.lit(None).cast("string")
    for t, u in DEFAULT_UNIT.items():
        out = F.when(target == t, F.lit(u)).otherwise(out)
    return out


def unit_in_brackets(c: Column) -> Column:
    return unit(F.regexp_extract(c, UNIT_IN_BRACKETS, 1))


def target_type(c: Column) -> Column:
    """The first target named, in upper case; INHIBITION_ZONE where only a zone is; else null."""
    return F.coalesce(_or_null(F.upper(F.regexp_extract(c, TARGET, 1))), F.when(c.rlike(ZONE), F.lit("INHIBITION_ZONE")))


def organism(c: Column) -> Column:
    """The first organism of the list, in its order, that the text names. Most texts name none, which
    one pattern tells."""
    first = lambda x: F.coalesce(*(F.when(x.rlike(rf"(?iuU)\b(?:{p})\b"), F.lit(name)) for name, p in ORGANISMS))
    return let(c, lambda x: F.when(x.rlike(EPITHET), first(x)))


def _only(c: Column, told: Column) -> Column:
    """measured() of a text that holds one number, as most cells do, and no letter beside it: told is
    its relation, value, unit and an empty text. No offsets are summed."""
    relation, value, units = (F.get(told, F.lit(k)) for k in range(3))
    whole = F.regexp_extract(c, VALUE, 0)
    at = F.instr(c, whole) - 1  # it has all digits of the text, so it's there once
    near = F.substring(c, F.greatest(at - 30, F.lit(0)) + 1, F.least(at, F.lit(30)) + F.length(whole) + 30)
    named = (units != "") | near.rlike(TARGET)
    hit = F.struct(F.when(relation != "", relation).alias("relation"), F.replace(value, F.lit(","), F.lit(".")).alias("value"), F.when(units != "", replaced(units, SAME_UNIT)).alias("units"))
    return F.when(named | c.rlike(BARE_VALUE), hit.cast(MEASURED))


def measured(c: Column) -> Column:
    """Relation, value and unit of the first number that no letter touches and that has a unit, or
    a target within 30 characters, or is the whole text; null if there is none.

    A regular-expression function gives no offsets; of several numbers they are summed from the matches
    and from the gaps between them. Gaps are split at a character that stands for a match: a split at a
    pattern would compile it for each text."""

    def found(m: Column) -> Column:
        whole, gaps = m["whole"], m["gaps"]
        sizes = F.transform(whole, lambda w, i: F.length(F.get(gaps, i)) + F.length(w))
        start = lambda i: F.when(i == 0, 0).otherwise(F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)) + F.length(F.get(gaps, i))

        def one(w: Column, i: Column) -> Column:
            def parts(v: Column) -> Column:
                return F.struct(start(i).alias("at"), v.alias("value"), (F.instr(w, v) - 1).alias("head"), w.alias("w"), F.get(m["units"], i).alias("units"))

            return let(let(F.get(m["values"], i), parts), judged)

        def judged(s: Column) -> Column:
            at = s["at"] + s["head"]
            before, after = F.substring(c, at, F.lit(1)), F.substring(c, at + F.length(s["value"]) + 1, F.lit(1))
            touched = (before.rlike(r"\p{L}") & (at > 0)) | after.rlike(r"\p{L}")
            left = F.greatest(s["at"] - 30, F.lit(0))
            near = F.substring(c, left + 1, s["at"] - left + F.length(s["w"]) + 30)
            named = (s["units"] != "") | near.rlike(TARGET)
            sign = F.regexp_extract(s["w"], r"\A(?:<=|>=|=|<|>)", 0)
            value = F.replace(s["value"], F.lit(","), F.lit("."))
            hit = F.struct(_or_null(sign).alias("relation"), value.alias("value"), F.when(named, unit(s["units"])).alias("units"))
            return F.when(~touched & (named | c.rlike(BARE_VALUE)), hit.cast(MEASURED))

        return F.get(F.array_compact(F.transform(whole, one)), 0)

    matches = lambda group: F.regexp_extract_all(c, F.lit(VALUE), F.lit(group))
    bare = F.replace(c, F.lit("\0"), F.lit("\1"))
    gaps = F.split(F.regexp_replace(bare, VALUE, "\0"), "\0", -1)
    one_number = F.split(F.regexp_replace(bare, ONE_NUMBER, "$1\0$2\0$3\0"), "\0", -1)  # the text as a whole if it has several
    parts = F.struct(matches(0).alias("whole"), matches(2).alias("values"), matches(3).alias("units"), gaps.alias("gaps"))
    return let(one_number, lambda told: F.when(F.size(told) > 1, _only(c, told)).when(c.rlike(r"(?U)\d"), let(parts, found)))


def measured_cell(cell: Column, column: Column) -> Column:
    """measured() of a cell, else of its column's name and the cell."""
    return F.coalesce(measured(cell), F.when(column != "", let(F.concat(column, F.lit(" "), cell), measured)))


def compound_column(columns: Column, cells: Column) -> Column:
    """Index of the first column named like one of compounds, else of the first of two cells that is
    a compound id; null if there is none."""
    index = lambda flags: F.nullif(F.array_position(flags, True) - 1, F.lit(-1).cast("bigint"))
    by_name = index(F.transform(columns, lambda x: x.rlike(COMPOUND_COLUMN)))
    by_cell = index(F.transform(F.slice(cells, 1, 2), lambda x: strip(x).rlike(rf"(?iuU)\A(?:{COMPOUND})\z")))
    return F.coalesce(by_name, by_cell).cast("int")


def compound_id(cells: Column, text: Column, index: Column) -> Column:
    """The compound column's cell, else an id in the first two cells, else one in the text."""
    pick = lambda x: _or_null(F.regexp_extract(x, "(?iuU)" + COMPOUND, 1))
    own = let(strip(F.get(cells, index)), lambda x: F.when((x != "") & ~no_value(x), x))
    return F.coalesce(own, pick(F.get(cells, F.lit(0))), pick(F.get(cells, F.lit(1))), pick(text))


def compound_range(c: Column) -> Column:
    return F.when(c.rlike(COMPOUND_RANGE), F.concat(F.regexp_extract(c, COMPOUND_RANGE, 1), F.lit("-"), F.regexp_extract(c, COMPOUND_RANGE, 2)))


def variable_sites(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(VARIABLE_SITE), F.lit(0))))


def smiles_of_text(c: Column) -> Column:
    keyed = _or_null(strip(F.regexp_extract(c, SMILES_KEY, 1)))
    marked = F.when(F.contains(c, F.lit(SMILES_MARK)), strip(F.substring_index(strip(F.regexp_replace(c, rf"(?s)\A.*?{SMILES_MARK}", "")), "|", 1)))
    return _or_null(F.coalesce(keyed, marked))


def compound_of_smiles(metadata: Column, text: Column, caption: Column) -> Column:
    """The compound that a structure belongs to: from its metadata, its text, or its caption if that
    is an id."""
    told = lambda path: _or_null(strip(F.get_json_object(metadata, path)))
    by_caption = let(strip(caption), lambda bare: F.when(bare.rlike(rf"(?iuU)\A(?:{COMPOUND})\z") & (bare != "NOT_DETECTED"), bare))
    return F.coalesce(told("$.compound_id"), told("$.chemical_agent_record.compound_id"), _or_null(strip(F.regexp_extract(text, COMPOUND_KEY, 1))), by_caption)


def context(*parts: Column) -> Column:
    """The parts that aren't empty, joined by bars."""
    return F.array_join(present(*parts), " | ")
