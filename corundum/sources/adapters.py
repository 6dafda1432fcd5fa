"""Edges of the engine: parsers of files and model clients, given as plain functions.

None is needed by the core. A parser or client is made once in each worker by a factory, so that a
model is loaded once, and rows travel in Arrow batches. What fails is a row with an error, never a
failed task."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.core import let
from corundum.functions.values import strip
from corundum.schemas import MISSING, Domain

#: Makes, once in each worker, a function of system text, prompt and images that gives a model's text.
Client = Callable[[], Callable[[str, str, list[bytes]], str]]

PAGE = "doc_id string, page_number int, width double, height double, text string, tables array<string>, image binary, error string"
ANSWER = "request_id string, content string, error string"
#: Answers that are given back at a time, and the characters with which fewer are. Requests are taken from
#: a batch one by one: a batch is bounded by its bytes, Python's objects of many requests and answers, which
#: grow with the documents, would be several times that.
AT_ONCE = 32
MOST_CHARS = 2**20


def parse_files(files: DataFrame, factory: Callable[[], Callable[[bytes], list[dict]]], *, first: int | None = None) -> DataFrame:
    """Pages of files (doc_id, content), as a parser gives them: dicts of the fields of PAGE but for
    doc_id, page_number and error. first: pages of a file to keep."""
    names = ["width", "height", "text", "tables", "image"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = factory()
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples():
                try:
                    pages = parse(bytes(r.content))
                    out += [(r.doc_id, n, *(p.get(k) for k in names), None) for n, p in enumerate(pages[:first], 1)]
                except Exception as e:  # one bad file mustn't stop the others
                    out.append((r.doc_id, None, None, None, None, None, None, str(e)[:1000]))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", *names, "error"])

    return files.select("doc_id", "content").mapInPandas(run, PAGE)


def complete(requests: DataFrame, factory: Client, *, per_second: float | None = None) -> DataFrame:
    """request_id, content, error of requests (request_id, system, prompt, images), asked of a
    client: a function of system text, prompt and images that gives the model's text. per_second:
    requests of one task in a second, at most. A task that is run again asks again: sources.answers
    keeps what was answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, next_at = factory(), 0.0
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if per_second:
                    time.sleep(max(0.0, next_at - time.monotonic()))
                    next_at = time.monotonic() + 1 / per_second
                try:
                    out.append((r["request_id"], ask(r["system"], r["prompt"], r["images"] or []), None))
                except Exception as e:
                    out.append((r["request_id"], None, str(e)[:1000]))
                size += len(out[-1][1] or "")
                if len(out) == AT_ONCE or size >= MOST_CHARS or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], ["request_id", "content", "error"])
                    out, size = [], 0

    return requests.select(F.col("request_id").cast("string"), "system", "prompt", "images").mapInArrow(run, ANSWER)


def json_payload(c: Column) -> Column:
    """The JSON in a model's text as a variant: the whole without a code fence, else its outermost
    list, else its outermost object; null if none parses."""
    bare = strip(F.regexp_replace(strip(c), r"(?s)\A```[A-Za-z]*\s*|\s*```\z", ""))
    between = lambda x, a, b: F.regexp_extract(x, rf"(?s)(\{a}.*\{b})", 1)
    return let(bare, lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(between(x, "[", "]")), F.try_parse_json(between(x, "{", "}"))))


def sample_rows(answers: DataFrame, d: Domain, *, by: str = "request_id") -> DataFrame:
    """A row for each sample of answers (by, content): the domain's columns as strings. Unknown keys
    go; an answer may be a list or an object with samples."""
    v = json_payload(F.col("content"))
    rows = answers.select(by, v.alias("v")).where("v is not null")
    listed = F.coalesce(F.try_variant_get("v", "$.samples", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))
    one = rows.select(by, F.explode(listed).alias("s"))
    names = {a: t for a, t in d.aliases.items()} | {c: c for c in d.columns}
    key = lambda n: "$['" + n.replace("'", "\\'") + "']"
    value = lambda c: F.coalesce(*(F.try_variant_get("s", key(n), "string") for n, t in names.items() if t == c), F.lit(MISSING))
    return one.select(by, *(value(c).alias(c) for c in d.columns))


def structured_schema(d: Domain, *, with_evidence: bool = False) -> dict:
    """The JSON Schema of an answer: every column required, of text, number or null; enumerated
    ones with the mark for missing."""
    of = lambda c: {"type": ["string", "number", "null"]} | ({"enum": [*d.enums[c], MISSING]} if c in d.enums else {})
    properties = {c: of(c) for c in d.columns}
    if with_evidence:
        properties |= {"_evidence": {"type": ["string", "null"]}, "_page": {"type": ["number", "null"]}}
    item = {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    return {"type": "object", "properties": {"samples": {"type": "array", "items": item}}, "required": ["samples"], "additionalProperties": False}


def fields_markdown(d: Domain) -> str:
    kind = lambda c: "number" if c in d.numeric else "string"
    allowed = lambda c: f" Allowed values: {', '.join(d.enums[c])}." if c in d.enums else ""
    return "\n".join(f"- `{c}` ({kind(c)}){allowed(c)}" for c in d.columns)


def _asked(d: Domain, kind: str, extra: bool) -> str:
    return f"{kind} {d.title} records. Answer with JSON of this schema: {json.dumps(structured_schema(d, with_evidence=extra), ensure_ascii=False)}"


def window_requests(windows: DataFrame, d: Domain) -> DataFrame:
    """Requests for windows of pages (doc_id, window, text)."""
    prompt = F.concat(F.lit(f"Fields:\n{fields_markdown(d)}\n\nText:\n"), F.col("text"))
    return windows.select("doc_id", F.concat_ws(":", "doc_id", F.col("window").cast("string")).alias("request_id"), F.lit(_asked(d, "Extract", True)).alias("system"), prompt.alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))


def review_requests(candidates: DataFrame, contexts: DataFrame, d: Domain, *, by: str = "doc_id") -> DataFrame:
    """A request for each document: its candidate rows (by and the domain's columns) as JSON, under
    the text they came from (contexts: by, text). A document's candidates are gathered: they are as
    many as one answer may hold."""
    sample = F.struct(*(F.col(f"`{x}`") for x in d.columns))
    listed = candidates.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(sample))).alias("samples"))
    prompt = F.concat(F.lit(f"Fields:\n{fields_markdown(d)}\n\nText:\n"), F.coalesce("text", F.lit("")), F.lit('\n\nCandidates:\n{"samples": '), "samples", F.lit("}"))
    both = listed.join(contexts.select(by, "text"), by, "left")
    return both.select(by, F.col(by).cast("string").alias("request_id"), F.lit(_asked(d, "Review candidates and give the final", False)).alias("system"), prompt.alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))


#: Images that a client is given: kinds by suffix, and the most bytes of one.
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
MOST_IMAGE_BYTES = 20 * 2**20


def image_problem(path: Column, size: Column) -> Column:
    """Why an image can't be sent; null if it can."""
    known = F.lit(False)
    for suffix in IMAGE_TYPES:
        known = known | F.endswith(F.lower(path), F.lit(suffix))
    return F.when(~known, "the image type isn't known").when(size > MOST_IMAGE_BYTES, "the image is too large")


def image_url(path: Column, content: Column) -> Column:
    """An image as a data address."""
    kind = F.lit(None).cast("string")
    for suffix, name in IMAGE_TYPES.items():
        kind = F.when(F.endswith(F.lower(path), F.lit(suffix)), F.lit(name)).otherwise(kind)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def answer_text(c: Column) -> Column:
    """The text of a chat answer (JSON): the first choice's content, texts of a list of parts joined."""
    content = let(F.try_parse_json(c), lambda v: F.struct(F.try_variant_get(v, "$.choices[0].message.content", "string").alias("one"), F.try_variant_get(v, "$.choices[0].message.content", "array<variant>").alias("parts")))
    return let(content, lambda x: F.coalesce(F.when(x["parts"].isNotNull(), F.array_join(F.transform(x["parts"], lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")), x["one"], F.lit("")))
