"""Column functions that bring extracted values into their canonical form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corundum.functions.core import let
from corundum.schemas import MISSING, Domain

# Words for a missing value, text forms and units that count as the same.
MISSING_WORDS = ("N/A", "NA", "NONE", "NULL", "NOT FOUND", "NOT_DETECTED")
NO_ARTICLE = ("nan", "none", "null", "not_detected")
SAME_TEXT = (
    ("10^-", "10-"), ("10−", "10-"), ("s^-1", "s-1"), ("s⁻¹", "s-1"), ("min^-1", "min-1"), ("min⁻¹", "min-1"),
    ("μg mL^-1", "μg mL−1"), ("μg mL-1", "μg mL−1"), ("ug mL^-1", "μg mL−1"), ("ug mL-1", "μg mL−1"), ("µg mL^-1", "μg mL−1"), ("µg mL-1", "μg mL−1"),
    ("mg mL^-1", "mg mL−1"), ("mg mL-1", "mg mL−1"), ("α-", ""), ("α–", ""), ("alpha-", ""),
)
ROOM_TEMPERATURE = ("room temperature", "rt", "ambient temperature", "not room temperature")
ABOUT = r"(?i)^(?:~|≈|about |ca\. )"
KEEPS_PDF = frozenset({"cytotoxicity", "seltox", "synergy", "magnetic"})
WHOLE_AS_DECIMAL = {"nanozymes": frozenset({"c_min", "c_max", "c_const", "ccat_value", "ph", "temperature"})}
ARTICLE_COLUMNS = {"eyedrops": ("pdf", "PMID", "doi", "title")}
#: What Python's strip() removes and \s matches there.
SPACE = r"[\s\x0B\x1c-\x1f\u0085\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin("", MISSING)


def canonical_text(c: Column) -> Column:
    return replaced(c, SAME_TEXT)


def value(c: Column) -> Column:
    """Stripped; MISSING if null, empty or a word for missing; else canonical text."""
    return let(strip(c), lambda bare: F.when(bare.isNull() | (bare == "") | F.upper(bare).isin(*MISSING_WORDS), F.lit(MISSING)).otherwise(canonical_text(bare)))


def general(x: Column, digits: int = 12) -> Column:
    """A double with so many significant digits, no trailing zeros, an exponent of two digits at
    least outside 1e-4 to 10**digits: the general format of C."""
    point = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("."), b))
    bare = lambda s: F.regexp_replace(s, "0+$", "")

    def parts(text: Column) -> Column:
        figures = F.regexp_replace(F.substring_index(text, "e", 1), r"[-.]", "")
        return F.struct(F.startswith(text, F.lit("-")).alias("negative"), figures.alias("figures"), F.substring_index(text, "e", -1).try_cast("int").alias("power"))

    def written(p: Column) -> Column:
        figures, power = p["figures"], p["power"]
        tail = bare(F.substring(figures, 2, digits))
        scientific = F.concat(point(F.left(figures, F.lit(1)), tail), F.format_string("e%s%02d", F.when(power < 0, "-").otherwise("+"), F.abs(power)))
        large = point(F.left(figures, power + 1), bare(F.substring(figures, power + 2, F.lit(digits))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare(figures))
        number = F.when((power < -4) | (power >= digits), scientific).when(power >= 0, large).otherwise(small)
        return F.concat(F.when(p["negative"], F.lit("-")).otherwise(F.lit("")), F.when(x == 0, F.lit("0")).otherwise(number))

    return F.when(x.isNotNull(), let(let(F.format_string(f"%.{digits - 1}e", x), parts), written))


def scientific_product(c: Column) -> Column:
    """'13.5 × 10⁻⁸' as '1.35e-07'; null if c isn't a coefficient times a power of ten."""

    def product(plain: Column) -> Column:
        out = F.lit(None).cast("string")
        for marker in ("*10", "x10", "×10"):
            coefficient = F.substring_index(plain, marker, 1)
            exponent = F.substring(plain, F.length(coefficient) + 4, F.length(plain))
            number = F.when(coefficient.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), coefficient.try_cast("double"))
            power = F.when(exponent.rlike(r"^[+-]?\d+$"), exponent.try_cast("int"))
            out = F.when(F.contains(plain, F.lit(marker)), let(number * F.pow(F.lit(10.0), power), lambda x: general(x))).otherwise(out)
        return out

    return let(F.translate(c, "−⁻⁰¹²³⁴⁵⁶⁷⁸⁹^ ", "--0123456789"), product)


def numeric_text(c: Column, *, temperature: bool = False) -> Column:
    """A number as text: no sign of approximation, no error, powers of ten worked out."""

    def cut(sign: str) -> Callable[[Column], Column]:
        return lambda x: F.when(F.contains(x, F.lit(sign)), strip(F.substring_index(x, sign, 1))).otherwise(x)

    def number(whole: Column) -> Column:
        bare = F.when(whole.rlike(ABOUT), strip(F.regexp_replace(whole, ABOUT, ""))).otherwise(whole)
        out = let(let(let(bare, cut("±")), cut("+/-")), lambda x: F.coalesce(scientific_product(x), F.when(x == "", F.lit(MISSING)).otherwise(x)))
        return F.when(F.lower(whole).isin(*ROOM_TEMPERATURE), F.lit(MISSING)).otherwise(out) if temperature else out

    return let(c, number)


def whole_as_decimal(c: Column) -> Column:
    """'25' as '25.0'; anything else but surrounding space unchanged."""

    def written(p: Column) -> Column:
        bare = p["bare"]
        digits = F.regexp_replace(F.regexp_replace(bare, r"^[+-]", ""), r"^0+(?=\d)", "")
        sign = F.when(F.startswith(bare, F.lit("-")) & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
        return F.when((bare == "") | (bare == MISSING), p["c"]).when(bare.rlike(r"^[+-]?\d+$"), F.concat(sign, digits, F.lit(".0"))).otherwise(bare)

    return let(F.struct(strip(c).alias("bare"), c.alias("c")), written)


def field_value(d: Domain, name: str, c: Column) -> Column:
    out = value(c)
    if name in d.numeric:
        out = numeric_text(out, temperature=name == "temperature")
        if name in WHOLE_AS_DECIMAL.get(d.key, ()):
            out = whole_as_decimal(out)
    return out


def decimal_point(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def article_of_file(c: Column) -> Column:
    """A file's name without its folder and a final .pdf."""
    return F.regexp_replace(F.element_at(F.split(strip(c), "/"), -1), r"(?i)\.pdf$", "")


def pdf_identifier(d: Domain, c: Column) -> Column:
    """The article id that a domain's tables use: with .pdf in four domains, without elsewhere."""
    name = F.element_at(F.split(strip(c), "/"), -1)
    if d.key in KEEPS_PDF:
        return F.when(F.endswith(F.lower(name), F.lit(".pdf")), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def clean_article(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare.isNull() | (bare == "") | F.lower(bare).isin(*NO_ARTICLE), F.lit(MISSING)).otherwise(bare)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:16 hex digits of the SHA-1 of the parts joined by |; null is written None."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(F.encode(text, "utf-8")), 1, 16))


def json_strings(c: Column) -> Column:
    """A JSON array as strings (null as ''), any other JSON or text as the only element."""

    def listed(v: Column) -> Column:
        parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
        one = F.array(F.coalesce(F.try_variant_get(v, "$", "string"), c))
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), parts).otherwise(one)

    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(let(F.try_parse_json(c), listed))


def confidence(c: Column) -> Column:
    """A confidence from 0.01 to 0.99; percents are divided, text that is no number counts 0.75."""
    x = c.try_cast("double")
    share = F.when(x > 1, x / 100).otherwise(x)
    return F.when(x.isNull(), F.lit(0.75)).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.01), share)))


def as_float(c: Column) -> Column:
    """A number, or null where a value is none."""
    return strip(c.cast("string")).try_cast("double")


def redacted(c: Column, secret: str, limit: int = 1000) -> Column:
    return F.left(F.replace(c, F.lit(secret), F.lit("***")) if secret else c, F.lit(limit))
