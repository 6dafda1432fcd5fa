"""Links of web pages and of open-access answers, and what becomes of downloads. Fetching is an
adapter: pages, answers and beginnings of files come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.core import let
from corundum.functions.text import is_supplement
from corundum.functions.values import strip

#: An anchor's attributes: name, and value in either quotes or bare.
ANCHOR = r"(?is)<a\s+([^>]*)>"
ATTRIBUTE = r"""(?s)([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
#: Bytes of a file's beginning that are looked at, bytes that a file has at least, supplements that
#: are joined to an article.
PDF_HEAD, LEAST_PDF, MOST_SUPPLEMENTS = 2048, 1024, 5

c = F.col


def _attributes(tag: Column) -> Column:
    """name and value of each attribute of a tag's inside."""

    def read(x: Column) -> Column:
        value = lambda k: F.regexp_extract(x, ATTRIBUTE, k)
        return F.struct(F.lower(value(1)).alias("name"), F.concat(value(2), value(3), value(4)).alias("value"))

    return F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), read)


def anchors(pages: DataFrame, *, by: str = "page_id", url: str | None = "url", html: str = "html") -> DataFrame:
    """by, position (from 0), href, link (as seen from the page; with url only) and label (the text of
    all attributes) of every anchor with an address."""
    tags = pages.select(by, *([url] if url else []), F.explode(F.transform(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1)), lambda t, i: F.struct(i.alias("position"), _attributes(t).alias("a")))).alias("t"))
    href = F.get(F.filter("t.a", lambda x: x["name"] == "href"), F.lit(0))["value"]
    out = tags.withColumn("href", href).where("href <> ''").select(by, *([url] if url else []), "t.position", "href", F.array_join(F.transform("t.a", lambda x: x["value"]), " ").alias("label"))
    return out.withColumn("link", absolute(c(url), c("href"))).drop(url) if url else out


def absolute(base: Column, href: Column) -> Column:
    """A link as seen from its page: whole ones stay, rooted ones get the page's host, others its
    folder; steps up and in place are taken."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    under = F.when((folder == "") | (F.length(folder) <= F.length(host)), F.concat(host, F.lit("/"))).otherwise(folder)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    joined = F.when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(host, href)).when(F.startswith(href, F.lit("?")) | F.startswith(href, F.lit("#")), F.concat(F.when(F.startswith(href, F.lit("#")), F.regexp_extract(base, r"^([^#]*)", 1)).otherwise(page), href)).otherwise(F.concat(under, href))
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).otherwise(F.when(F.contains(joined, F.lit("/.")), _flat(joined)).otherwise(joined))


def _flat(link: Column) -> Column:
    """A link without . and .. in its path."""
    parts = F.struct(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("host"), F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(link, r"([?#].*)$", 1).alias("rest"))

    def walked(path: Column) -> Column:
        steps = F.split(F.substring(path, 2, F.length(path)), "/")
        go = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
        ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), go), ends), "/"))

    return let(parts, lambda p: F.concat(p["host"], walked(p["path"]), p["rest"]))


def supplements(pages: DataFrame, *, by: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """by, position, link: the first of each supplementary PDF that a page links to, told by its
    address or by any text of its anchor."""
    found = anchors(pages, by=by, url=url, html=html).where(is_supplement(F.lower(F.concat_ws(" ", "link", "label"))))
    return found.groupBy(by, "link").agg(F.min("position").alias("position"))


def pdf_candidates(answers: DataFrame, *, by: str = "doi", answer: str = "answer") -> DataFrame:
    """by and candidates: PDF addresses of an open-access answer (JSON), the primary location first,
    then all locations, then the open-access address; the first of equals stays."""
    v = F.from_json(F.col(answer), "primary_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>, open_access struct<oa_url:string>")
    listed = F.concat(F.array(v["primary_location"]["pdf_url"]), F.coalesce(F.transform(v["locations"], lambda x: x["pdf_url"]), F.array().cast("array<string>")), F.array(v["open_access"]["oa_url"]))
    return answers.select(by, F.array_distinct(F.filter(F.transform(listed, strip), lambda x: x.isNotNull() & (x != ""))).alias("candidates"))


def landing_pages(doi: Column, source_urls: Column) -> Column:
    """Where an article's page may be: its DOI, and where a publisher keeps the page of a PDF."""
    page = F.transform(F.filter(source_urls, lambda u: F.contains(u, F.lit("/articlepdf/"))), lambda u: strip(F.replace(u, F.lit("/articlepdf/"), F.lit("/articlelanding/"))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("https://doi.org/"), doi)), page))


def is_pdf(head: Column, content_type: Column, size: Column) -> Column:
    """Whether a download is a PDF: by its first bytes or its declared type, and not a stub."""
    marked = F.contains(F.substring(head, 1, PDF_HEAD), F.lit(b"%PDF"))
    return (F.coalesce(marked, F.lit(False)) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))) & (size > LEAST_PDF)


def manifest(articles: DataFrame, there: DataFrame, downloads: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """doi, pdf, status, source_url, supplementary_pdfs of each article (doi, pdf): exists if its file
    is there already, else downloaded from the first of its candidates that was a PDF, with up to
    MOST_SUPPLEMENTS supplements, else not_found. downloads: doi, nth, url, supplement, is_pdf."""
    good = downloads.where("is_pdf")
    first = good.where("not supplement").groupBy("doi").agg(F.min_by("url", "nth").alias("source_url"))
    nth = F.row_number().over(Window.partitionBy("doi").orderBy("nth"))
    tried = downloads.where("supplement").withColumn("k", nth).where(c("k") <= MOST_SUPPLEMENTS)
    extra = tried.groupBy("doi").agg(F.count_if("is_pdf").alias("n"))
    known = there.select("pdf").distinct().withColumn("there", F.lit(True))
    out = articles.join(known, "pdf", "left").join(first, "doi", "left").join(extra, "doi", "left")
    skip = F.lit(False) if overwrite else F.coalesce("there", F.lit(False))
    n = F.coalesce("n", F.lit(0))
    status = F.when(skip, "exists").when(c("source_url").isNull(), "not_found").when(n > 0, "downloaded_with_supplementary").otherwise("downloaded")
    return out.select("doi", "pdf", status.alias("status"), F.when(~skip, c("source_url")).alias("source_url"), F.when(~skip & c("source_url").isNotNull(), n).alias("supplementary_pdfs"))


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def merged_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, page_number, and the rest of pages: an article's own pages, then those of its first
    supplements, numbered on. parts: doc_id, part_id, nth (0 is the article); pages: part_id, page_number."""
    kept = parts.where(c("nth") <= MOST_SUPPLEMENTS).withColumnRenamed("doc_id", "whole_id")
    both = pages.join(kept, "part_id")
    number = F.row_number().over(Window.partitionBy("whole_id").orderBy("nth", "page_number"))
    rest = [x for x in pages.columns if x not in ("part_id", "doc_id", "page_number")]
    return both.select(c("whole_id").alias("doc_id"), number.alias("new_number"), *rest).withColumnRenamed("new_number", "page_number")
