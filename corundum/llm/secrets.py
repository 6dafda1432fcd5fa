"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by its content: sha256 of the text. A ledger, two
Parquet tables in a folder, holds which (blob, rule version) pairs have been scanned and what was
found in them, each in folders by rule version. An update scans one representative text of each blob
under those rules only that the ledger lacks for it, appends, and joins the findings back to all paths
that hold the blob: a changed rule is scanned anew, the others aren't, and versions that no rule has
now aren't read. It is DataFrame functions only: spans come from the lengths of a text's gaps between
matches, added up in blocks, so that very long texts with very many matches take no square of time.

Cases: null texts count as empty and have no findings; a null path keeps its row; repeated rows
keep theirs; an empty table gives an empty result; very long texts are scanned whole; other columns
are passed through, and a result whose name one of them has gets underscores before it; a run that
dies between its two appends scans the same blobs again, and findings are read as a set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corundum.llm.common import free_name, let

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of pattern are leftmost and don't overlap; those whose group is
    shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: A run of [0-9a-f]+ of 24 characters or more is the same match as [0-9a-f]{24,}, and a run after
#: AKIA is dropped or kept whole, so those two patterns hold their least lengths.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A private key: its BEGIN line, then lines of base64 or of headers up to its END line, or, where that
#: is cut off, runs of 40 base64 characters or more. Lines may end in the two characters of an escaped
#: line break, and a slash may be escaped, as in JSON. A mere mention of a BEGIN line is no key. Each
#: piece can match in one way only, and repetitions have bounds, so that no text takes long.
_BREAK = r"(?:\r|\n|\\[rn/])"
_HEADER = r"[A-Za-z][A-Za-z-]{0,40}:[^\r\n\\]{0,200}"
_LINES = rf"(?:[\x20\t]*(?:{_HEADER}|[A-Za-z0-9+/=]+[\x20\t]*)?{_BREAK}){{0,400}}[\x20\t]*(?:[A-Za-z0-9+/=]+[\x20\t]*)?-----END [A-Z ]{{0,30}}PRIVATE KEY-----"
_BLANK = r"(?:[\x20\t\r\n]|\\[rnt])"
_RUNS = rf"(?:{_BLANK}{{0,16}}{_HEADER}{_BREAK}){{0,8}}(?:{_BLANK}{{0,16}}[A-Za-z0-9+/=]{{40,}}){{1,400}}"
PRIVATE_KEY = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_LINES}|{_RUNS})"
#: What the method adds: formats that nothing but a credential has.
ADDED = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def version_of(rule: Rule) -> str:
    import hashlib

    return f"{rule.kind}-{hashlib.sha256(repr(rule).encode()).hexdigest()[:16]}"


#: Elements of an array that are added up one by one; longer ones by blocks of so many.
ADDED_UP = 64


def running(numbers: Column) -> Column:
    """Sums of an array up to and including each element. An array that grows by one is copied each
    time, so blocks are added up by themselves and then moved by the sums of those before."""
    empty = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.element_at(a, -1), F.lit(0))
    simple = lambda x, start: F.aggregate(x, start, lambda a, n: F.concat(a, F.array(F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0)) + n)))

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / ADDED_UP).cast("int")), lambda k: F.slice(x, k * ADDED_UP + 1, ADDED_UP))
        return let(F.transform(parts, lambda p: simple(p, empty)), moved)

    def moved(sums: Column) -> Column:
        ends = simple(F.transform(sums, lambda p: last(p)), empty)
        return let(ends, lambda e: F.flatten(F.transform(sums, lambda p, k: F.transform(p, lambda n: n + F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))))))

    return F.when(F.size(numbers) <= ADDED_UP, simple(numbers, empty)).otherwise(blocks(numbers))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, the end exclusive."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        *([F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("tested")] if rule.group else []),
    )

    def found(p: Column) -> Column:
        sizes = F.transform(p["whole"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m))
        span = lambda end, i: F.struct(F.lit(rule.kind).alias("kind"), (end - F.length(F.get(p["whole"], i))).alias("start"), end.alias("end"))
        good = lambda i: F.length(F.get(p["tested"], i)) >= rule.least if rule.group else F.lit(True)
        return F.array_compact(F.transform(let(sizes, running), lambda end, i: F.when(good(i), span(end, i))))

    return F.when(text.rlike(rule.pattern), let(parts, found)).otherwise(F.array().cast(SPANS))


def by_place(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans by start, then in the order of the rules."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(ranked), lambda x: x["span"])


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """What has been scanned and found, in folder: shared storage on a cluster."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder, rules
        self.versions = [version_of(r) for r in rules]

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table's rows under the present rules; the folders of others aren't listed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        paths = []
        for v in self.versions:
            path = hadoop(f"{self.folder}/{name}/rule={v}")
            if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                paths.append(str(path))
        if paths:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)
        return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))

    def scanned(self) -> DataFrame:
        """blob and rule, a version of the present ones."""
        return self._read("scanned", "blob binary, rule string")

    def findings(self) -> DataFrame:
        """blob and spans, one row a blob with any, under the present rules."""
        rows = self._read("findings", f"blob binary, spans {SPANS}, rule string")
        once = rows.groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
        return once.groupBy("blob").agg(by_place(F.flatten(F.collect_list("spans")), self.rules).alias("spans"))  # a row for each rule at most

    def update(self, versions: DataFrame, *, path: str = "path", text: str = "text") -> None:
        """Scan each blob of versions under the rules that are new to it. Texts are shuffled by path
        to meet their blob's representative, so many paths with one blob aren't gathered."""
        named = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
        every = F.array(*map(F.lit, self.versions))
        seen = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        new = named.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
        new = new.select(F.col("blob").alias("b"), F.col("path").alias("p"), F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen")).alias("open")).where(F.size("open") > 0)
        texts = named.join(new, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")))
        none = F.array().cast(SPANS)
        of_rule = lambda rule, v: F.struct(F.lit(v).alias("rule"), F.when(F.array_contains("open", v), spans_of(F.col("text"), rule)).otherwise(none).alias("spans"))
        found = texts.select("blob", F.explode(F.array(*(of_rule(r, v) for r, v in zip(self.rules, self.versions)))).alias("f"))
        found.select("blob", "f.spans", "f.rule").where(F.size("spans") > 0).write.mode("append").partitionBy("rule").parquet(f"{self.folder}/findings")
        done = new.select(F.col("b").alias("blob"), F.explode("open").alias("rule"))
        done.write.mode("append").partitionBy("rule").parquet(f"{self.folder}/scanned")

    def attach(self, df: DataFrame, *, text: str = "text", into: str = "spans") -> DataFrame:
        """df with the spans of each row's text, from the ledger; an empty array where none."""
        key, other, found, name = (free_name(df, n) for n in ("blob", "blob_found", "found_spans", into))
        known = self.findings().select(F.col("blob").alias(other), F.col("spans").alias(found))
        joined = df.withColumn(key, address(F.col(f"`{text}`"))).join(known, F.col(key) == F.col(other), "left")
        return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.col(found), F.array().cast(SPANS)).alias(name))


def redact(text: Column, spans: Column) -> Column:
    """text with each span, overlapping ones as one, replaced by the kind of its first. Spans come by
    start. Of each the end that any before it reaches is known, so pieces are cut independently."""
    none = F.array().cast("array<int>")
    reach = F.transform(spans, lambda s: s["end"])
    highest = lambda x: F.coalesce(F.array_max(x), F.lit(0))

    def reached(ends: Column) -> Column:
        """The greatest end up to and including each, by blocks."""
        upto = lambda p: F.aggregate(p, none, lambda a, n: F.concat(a, F.array(F.greatest(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)), n))))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / ADDED_UP).cast("int")), lambda k: F.slice(ends, k * ADDED_UP + 1, ADDED_UP))
        tops = lambda ps: F.struct(ps.alias("parts"), upto(F.transform(ps, highest)).alias("tops"))
        return let(let(parts, tops), lambda x: F.flatten(F.transform(x["parts"], lambda p, k: F.transform(upto(p), lambda n: F.greatest(n, F.when(k > 0, F.get(x["tops"], k - 1)).otherwise(F.lit(0)))))))

    def cut(r: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(r, i - 1)).otherwise(F.lit(0))
        piece = lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        pieces = F.array_compact(F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), piece(s, i))))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(r, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(let(reach, reached), cut)).otherwise(text)


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
