"""Queries on records, values, links and settings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.functions import text, values
from corundum.operators import evaluate, heuristics, jobs, layout, normalize, visual
from corundum.plans.base import query, view
from corundum.schemas import DOMAINS, registry
from corundum.sources import adapters, tables, web

c = F.col

# Articles: which of several ids is given, and which are open.
ARTICLES = """SELECT CAST(c_custkey AS INT) AS k, CASE c_custkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' ELSE concat(' a/b', CAST(c_nationkey AS VARCHAR(20)), '.PDF ') END AS pdf, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR(20)) END AS "PMID", concat('10.1/', CAST(c_nationkey AS VARCHAR(20))) AS doi, 'None' AS title, CASE WHEN c_custkey % 5 = 0 THEN '1.0' ELSE 'no' END AS access FROM {customer}"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ARTICLES.replace('"PMID"', "`PMID`"))


@query(f"""SELECT k, CASE WHEN k % 4 > 1 THEN concat('b', regexp_extract(pdf, 'b(\\d+)', 1)) WHEN "PMID" IS NOT NULL THEN "PMID" ELSE regexp_replace(doi, '^.*/', '') END AS pdf FROM ({ARTICLES}) q WHERE access = '1.0'""")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.prepare_truth(DOMAINS["eyedrops"], _articles(spark, sf_dir)).select("k", "pdf")


@query(f"""SELECT DISTINCT doi, CASE WHEN k % 4 > 1 THEN trim(pdf) ELSE "PMID" END AS pdf_id FROM ({ARTICLES}) q WHERE access = '1.0' AND (k % 4 > 1 OR "PMID" IS NOT NULL)""")
def open_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.open_articles(_articles(spark, sf_dir), ids=("pdf", "PMID", "title")).select("doi", "pdf_id")


# Samples under aliases and with values to be put into form.
SAMPLES = """SELECT concat('x/', CAST(l_suppkey AS VARCHAR(20)), '.pdf') AS file, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS compound, CASE l_linenumber % 3 WHEN 0 THEN ' none ' WHEN 1 THEN concat('~', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' ± 2') ELSE concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' μg mL-1') END AS permeability, NULL AS smiles, 'x' AS other FROM {lineitem}"""


@query(f"""SELECT regexp_replace(regexp_replace(file, '^x/', ''), '\\.pdf$', '') AS pdf, compound AS name, CASE WHEN permeability = ' none ' THEN 'NOT_DETECTED' WHEN permeability LIKE '~%' THEN regexp_extract(permeability, '(\\d+)', 1) ELSE replace(permeability, 'mL-1', 'mL−1') END AS perm, 'NOT_DETECTED' AS smiles, 'NOT_DETECTED' AS "logP" FROM ({SAMPLES}) q""")
def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.sample_frame(DOMAINS["eyedrops"], view(spark, sf_dir, SAMPLES), c("file")).withColumnRenamed("perm (cm/s)", "perm")


@query(f"""SELECT regexp_replace(regexp_replace(file, '^x/', ''), '\\.pdf$', '') AS pdf, left(compound, 80) AS object_id, left(compound, 500) AS primary_value, CASE WHEN permeability = ' none ' THEN '' ELSE concat('perm (cm/s)=', CASE WHEN permeability LIKE '~%' THEN regexp_extract(permeability, '(\\d+)', 1) ELSE replace(permeability, 'mL-1', 'mL−1') END) END AS property FROM ({SAMPLES}) q""")
def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DOMAINS["eyedrops"]
    return heuristics.records_from_samples(normalize.sample_frame(d, view(spark, sf_dir, SAMPLES), c("file")), d.columns)


TOLD = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 200 AS VARCHAR(20)) WHEN 1 THEN 'sure' WHEN 2 THEN '0.5' WHEN 3 THEN '-3' WHEN 4 THEN NULL ELSE '0' END AS v FROM {events}"


@query(f"SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN least(0.99, greatest(0.01, CASE WHEN event_id % 200 > 1 THEN (event_id % 200) / 100.0 ELSE event_id % 200 END)) WHEN 2 THEN 0.5 WHEN 3 THEN 0.01 WHEN 5 THEN 0.01 ELSE 0.75 END, 6) AS sure FROM ({TOLD}) q", sure="DOUBLE")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TOLD).select("event_id", F.round(values.confidence(c("v")), 6).alias("sure"))


@query("SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_', replace(p_brand, '#', '_'), '.x') AS slug, left(concat('key *** of ', p_name), 20) AS error FROM part")
def names_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT p_partkey, concat('..', p_name, '//', p_brand, '.x-') AS n, concat('key s3cret of ', p_name) AS e FROM {part}")
    return rows.select("p_partkey", text.slug(c("n")).alias("slug"), values.redacted(c("e"), "s3cret", 20).alias("error"))


# What models answer: fenced, amid text, bare or broken.
@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE user_id END AS k FROM events", k="BIGINT")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = F.concat(F.lit('{"k":'), c("user_id").cast("string"), F.lit("}"))
    k = c("event_id") % 5
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), obj, F.lit(" done"))).when(k == 2, F.concat(F.lit("["), obj, F.lit("] as asked"))).when(k == 3, obj).otherwise("{broken")
    v = adapters.json_payload(answer)
    rows = view(spark, sf_dir, "SELECT event_id, user_id FROM {events}").select("event_id", v.alias("v"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$[0].k", "bigint")).alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('a', CAST(user_id AS VARCHAR)) WHEN 1 THEN concat('p', CAST(user_id AS VARCHAR), 'q') ELSE '' END AS said FROM events")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = c("user_id").cast("string"), c("event_id") % 3
    answer = F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":"a'), user, F.lit('"}}]}'))).when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":[{"text":"p'), user, F.lit('"},{"type":"x"},{"text":"q"}]}}]}'))).otherwise("nothing")
    return view(spark, sf_dir, "SELECT event_id, user_id FROM {events}").select("event_id", adapters.answer_text(answer).alias("said"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'Anna' ELSE concat('c', CAST(user_id AS VARCHAR)) END AS object_id, CASE event_id % 4 WHEN 0 THEN 'CCO' WHEN 1 THEN 'mat' ELSE 'not detected' END AS primary_value, CASE event_id % 4 WHEN 1 THEN 'schema field pending' ELSE '5 mM' END AS property, CASE event_id % 4 WHEN 0 THEN '0.90' ELSE '0.75' END AS confidence FROM events WHERE event_id % 4 < 2""")
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = c("user_id").cast("string"), c("event_id") % 4
    own = F.concat(F.lit('"object_id":"c'), user, F.lit('"'))
    answer = F.when(k == 0, F.concat(F.lit('{"records":[{'), own, F.lit(',"SMILES":"CCO","activity":"5 mM","confidence":90}]}'))).when(k == 1, F.concat(F.lit("[{"), own, F.lit(',"material":"mat"}]'))).when(k == 2, "[1, 2]").otherwise("broken")
    found = heuristics.records_from_model(view(spark, sf_dir, "SELECT event_id, user_id FROM {events}").withColumn("answer", answer), by="event_id")
    fixed = found.withColumn("property", F.when(c("property") == "mat", "schema field pending").otherwise(c("property")))
    return fixed.select("event_id", "object_id", "primary_value", "property", "confidence")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('c', CAST(user_id AS VARCHAR)) ELSE 'obj-001' END AS object_id, CASE event_id % 3 WHEN 0 THEN 'AgNP' ELSE concat('free ', event_type) END AS primary_value, CASE WHEN event_id % 2 = 0 THEN '7 mM' ELSE CASE event_id % 3 WHEN 0 THEN 'AgNP' ELSE concat('free ', event_type) END END AS property, '0.73' AS confidence FROM events""")
def row_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT event_id, user_id, event_type FROM {events}")
    free = F.when(c("event_id") % 3 == 0, F.create_map(F.lit("Material"), F.lit("AgNP"))).otherwise(F.create_map(F.lit("note"), F.concat(F.lit("free "), "event_type")))
    more = F.when(c("event_id") % 2 == 0, F.create_map(F.lit("compound_id"), F.concat(F.lit("c"), c("user_id").cast("string")), F.lit("MIC"), F.lit("7 mM"))).otherwise(F.create_map(F.lit("page"), F.lit("")))
    return heuristics.records_from_rows(rows.select("event_id", F.lit(1).alias("nth"), F.map_concat(free, more).alias("row")), by="event_id").drop("evidence")


# Statements put before and after the texts, two structures to pair them with, and a DOI.
STATED = "SELECT doc_id, concat('MIC of ', CAST(doc_id % 90 AS VARCHAR(20)), ' mM C1CCCC1=O. ', CASE WHEN doc_id % 2 = 0 THEN 'IC50: 2.5 nM and C2CCCC2=N. ' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'see 10.1234/ab.c end' ELSE 'end' END) AS text, doc_id % 90 AS v FROM {documents}"


@query(f"""WITH s AS ({STATED}) SELECT doc_id, 'mol-001' AS object_id, 'C1CCCC1=O' AS primary_value, concat('MIC of ', CAST(v AS VARCHAR), ' mM') AS property, CASE WHEN doc_id % 3 = 0 THEN '10.1234/ab.c' ELSE left(text, 96) END AS evidence, '0.78' AS confidence FROM s
UNION ALL SELECT doc_id, 'mol-002', 'C2CCCC2=N', 'IC50: 2.5 nM', CASE WHEN doc_id % 3 = 0 THEN '10.1234/ab.c' ELSE left(text, 96) END, '0.79' FROM s WHERE doc_id % 2 = 0""")
def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.records_from_text(view(spark, sf_dir, STATED), nano=False)


@query(f"""WITH s AS ({STATED}) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS detected_properties, CASE WHEN doc_id % 3 = 0 THEN '10.1234/ab.c' ELSE '' END AS detected_dois, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS detected_smiles, len(string_split(text, ' ')) AS text_tokens FROM s""", detected_properties="INTEGER", detected_smiles="INTEGER", text_tokens="INTEGER")
def source_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.source_summary(view(spark, sf_dir, STATED)).select("doc_id", "detected_properties", F.array_join("detected_dois", ",").alias("detected_dois"), "detected_smiles", "text_tokens")


# Materials are put before words that begin with some letters.
NANO = "SELECT doc_id, replace(replace(replace(replace(text, ' a', ' ZnO a'), ' b', ' AgNPs b'), ' s', ' silver nanoparticle s'), ' z', ' agnps z') AS text FROM {documents}"


@query(f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], ',') AS materials FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\\b(?:AgNPs?|AuNPs?|Fe3O4|TiO2|ZnO|SiO2|CeO2|magnetic nanoparticles?|silver nanoparticles?)\\b') AS l FROM ({NANO}) q) z")
def material_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NANO).select("doc_id", F.array_join(heuristics.materials(c("text")), ",").alias("materials"))


# Tokens are tens, so that no score ends in a five beyond the third digit, which engines round apart.
@query("""SELECT o_orderkey, round(least(0.88, greatest(0.05, CASE WHEN o_orderstatus = 'P' THEN 0.22 ELSE o_orderkey % 90 / 100.0 END + CASE WHEN o_orderstatus = 'F' THEN 0.35 ELSE 0.8 END * 0.12 + least(1.0, o_orderkey % 30 / 12.0) * 0.08 + least(0.12, o_orderkey % 300 / 1000.0))), 3) AS score FROM orders""", score="DOUBLE")
def heuristic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM {orders}")
    base = F.when(c("o_orderstatus") != "P", c("o_orderkey") % 90 / 100.0)
    return o.select("o_orderkey", heuristics.heuristic_score(base, F.when(c("o_orderstatus") != "F", 0.8), c("o_orderkey") % 30, c("o_orderkey") % 300 * 10).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'the file type isn''t known' WHEN p_size * 2000000 > 52428800 THEN 'the file is too large' END AS problem, CASE WHEN p_size % 4 IN (0, 3) THEN 'the image type isn''t known' WHEN p_size * 2000000 > 20971520 THEN 'the image is too large' END AS image_problem FROM part")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.Zip' WHEN 2 THEN 'c.md' ELSE 'd.exe' END AS n, CASE p_size % 4 WHEN 0 THEN 'a.gif' WHEN 1 THEN 'b.PNG' WHEN 2 THEN 'c.jpeg' ELSE 'd' END AS i, p_size * 2000000L AS size FROM {part}")
    return parts.select("p_partkey", tables.upload_problem(c("n"), c("size")).alias("problem"), adapters.image_problem(c("i"), c("size")).alias("image_problem"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN 'interrupted' ELSE event_type END AS status, user_id % 2 = 0 AS api_key_configured, '4,5,6' AS logs FROM events""")
def public_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT event_id, event_type AS status, CASE WHEN user_id % 2 = 0 THEN 'k' ELSE '' END AS api_key FROM {events}")
    state = F.when(c("status") == "click", "running").when(c("status") == "signup", "queued").otherwise(c("status"))
    found = jobs.public_view(jobs.interrupted(rows.withColumn("status", state).withColumn("logs", F.array(*(F.lit(str(i)) for i in range(1, 7))))), logs=3)
    return found.select("event_id", "status", "api_key_configured", F.array_join("logs", ",").alias("logs"))


URLS = "SELECT CAST(p_partkey AS INT) AS k, concat('10.1/', CAST(p_size AS VARCHAR(20))) AS doi, CASE p_size % 3 WHEN 0 THEN concat('https://x.org/content/articlepdf/', p_brand) WHEN 1 THEN concat('https://y.org/', p_brand) END AS u FROM {part}"


@query(f"SELECT k, concat('https://doi.org/', doi, CASE WHEN u LIKE '%articlepdf%' THEN concat(',', replace(u, '/articlepdf/', '/articlelanding/')) ELSE '' END) AS pages FROM ({URLS}) q")
def landing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = view(spark, sf_dir, URLS)
    return urls.select("k", F.array_join(web.landing_pages(c("doi"), F.array_compact(F.array("u", "u"))), ",").alias("pages"))


@query(f"SELECT k, concat_ws(',', u, CASE WHEN k % 2 = 0 THEN 'https://z.org/l.pdf' END, CASE WHEN k % 3 = 0 THEN 'https://z.org/oa' END) AS candidates FROM ({URLS}) q")
def pdf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = c("u")
    answer = F.to_json(F.struct(F.struct(u.alias("pdf_url")).alias("primary_location"), F.array(F.struct(u.alias("pdf_url")), F.struct(F.when(c("k") % 2 == 0, "https://z.org/l.pdf").alias("pdf_url"))).alias("locations"), F.struct(F.when(c("k") % 3 == 0, "https://z.org/oa").alias("oa_url")).alias("open_access")))
    return web.pdf_candidates(view(spark, sf_dir, URLS).withColumn("answer", answer), by="k").select("k", F.array_join("candidates", ",").alias("candidates"))


# Anchors as pages write them: quoted both ways or not at all, the word in the address or elsewhere.
PAGES = """SELECT p_partkey AS page_id, concat('https://h.org/a/', CAST(p_size AS VARCHAR(20)), '/page?x') AS url, concat('<a class="x" href="/supp/', CAST(p_size AS VARCHAR(20)), '.pdf">1</a> <A title=''Supporting information'' href=b.pdf>2</A> <a href="https://o.org/c.pdf">3</a> <a href="../ESI.PDF" data-x>4</a><a name="n">5</a> <a href="/supp/', CAST(p_size AS VARCHAR(20)), '.pdf">6</a>') AS html, p_size FROM {part}"""


@query(f"SELECT page_id, concat('https://h.org/a/', CAST(p_size AS VARCHAR), '/b.pdf') AS link, 1 AS position FROM ({PAGES}) q UNION ALL SELECT page_id, 'https://h.org/a/ESI.PDF', 3 FROM ({PAGES}) q", position="INTEGER")
def supplement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.supplements(view(spark, sf_dir, PAGES)).select("page_id", "link", "position")


# Downloads of articles: which are there, which candidates and supplements were PDFs.
@query("""WITH a AS (SELECT DISTINCT concat('10.', CAST(c_custkey AS VARCHAR)) AS doi, concat(CAST(c_custkey AS VARCHAR), '.pdf') AS pdf, c_custkey AS k FROM customer)
SELECT doi, pdf, CASE WHEN k % 7 = 0 THEN 'exists' WHEN k % 3 = 0 THEN 'not_found' WHEN k % 5 = 0 THEN 'downloaded' ELSE 'downloaded_with_supplementary' END AS status, CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN concat('u', CASE WHEN k % 2 = 0 THEN '1' ELSE '2' END) END AS source_url, CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE 5 END END AS supplementary_pdfs FROM a""", supplementary_pdfs="BIGINT")
def download_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "SELECT concat('10.', CAST(c_custkey AS STRING)) AS doi, concat(CAST(c_custkey AS STRING), '.pdf') AS pdf, c_custkey AS k FROM {customer}")
    k, nth = c("k"), c("nth")
    tried = a.select("doi", "k", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("nth")).withColumn("supplement", nth > 2)
    head = F.when(nth > 2, F.when(k % 5 == 0, F.lit("no")).otherwise(F.lit("%PDF-1"))).when((k % 3 != 0) & ((nth == 2) | (k % 2 == 0)), F.lit("%PDF")).otherwise("<html>")
    downloads = tried.withColumns({"url": F.concat(F.lit("u"), nth.cast("string")), "is_pdf": web.is_pdf(head.cast("binary"), F.lit("text/html"), F.lit(5000))})
    return web.manifest(a.select("doi", "pdf"), a.where("k % 7 = 0"), downloads)


@query("SELECT CASE WHEN k % 7 = 0 THEN 'exists' WHEN k % 3 = 0 THEN 'not_found' WHEN k % 5 = 0 THEN 'downloaded' ELSE 'downloaded_with_supplementary' END AS status, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) q GROUP BY 1")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.status_counts(_manifest(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number, concat('p', CAST(o_orderkey AS VARCHAR)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) q WHERE n <= 6", page_number="INTEGER")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT CAST(o_custkey AS STRING) AS doc_id, o_orderkey AS part_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM {orders}")
    return web.merged_pages(parts.select("part_id", F.lit(1).alias("page_number"), F.concat(F.lit("p"), c("part_id").cast("string")).alias("text")), parts)


@query("SELECT r_name AS name, d AS domain, n AS columns FROM region CROSS JOIN (SELECT 'nanozymes' AS d, 20 AS n UNION ALL SELECT 'magnetic', 24 UNION ALL SELECT 'cytotoxicity', 21 UNION ALL SELECT 'seltox', 23 UNION ALL SELECT 'synergy', 29) z", columns="BIGINT")
def registry_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = registry(spark).groupBy("domain").agg(F.count("*").alias("columns")).where("columns > 7")
    return view(spark, sf_dir, "SELECT r_name AS name FROM {region}").crossJoin(F.broadcast(wide))  # a row a domain


WIDE = "SELECT CAST(l_orderkey AS BIGINT) AS table_id, concat(CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS row_id, CAST(1 + l_linenumber % 3 AS INT) AS n FROM {lineitem}"


@query(f"WITH w AS ({WIDE}) SELECT row_id, table_id, concat('x', repeat(',x', n - 1), repeat(',', max(n) OVER (PARTITION BY table_id) - n)) AS cells FROM w")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, WIDE).withColumn("cells", F.array_repeat(F.lit("x"), c("n")))
    return layout.padded(rows, by=["table_id"]).select("row_id", "table_id", F.array_join("cells", ",").alias("cells"))


@query("""SELECT p_partkey, length(p_name) > 32 OR p_size % 5 = 0 AS super, p_size % 3 <> 2 AS row_label, p_size % 4 <> 3 AS is_value FROM part""")
def cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN concat('Inhibition Zone ', p_name) ELSE p_name END AS h, CASE p_size % 3 WHEN 0 THEN '-12b ' WHEN 1 THEN 'Ciprofloxacin' ELSE 'a b' END AS r, CASE p_size % 4 WHEN 0 THEN ' - ' WHEN 1 THEN '>5' WHEN 2 THEN 'x1' ELSE 'none' END AS v FROM {part}")
    return cells.select("p_partkey", F.coalesce(layout.is_super_header(c("h")), F.lit(False)).alias("super"), layout.is_row_label(c("r")).alias("row_label"), layout.is_value(c("v")).alias("is_value"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 4 THEN 'not_checked' ELSE 'invalid' END AS validity, CASE event_id % 5 WHEN 1 THEN '' WHEN 2 THEN 'C*.C' WHEN 4 THEN 'CO' ELSE 'CC' END AS smiles FROM events""")
def smiles_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id") % 5
    s = visual.clean_smiles(F.when(k == 1, " <Invalid> ").when(k == 2, "C*.C").when(k == 4, "CO").otherwise(" CC"))
    checked = F.when(k == 4, F.lit(None).cast("boolean")).otherwise(k != 3)
    return view(spark, sf_dir, "SELECT event_id FROM {events}").select("event_id", visual.validity(s, checked).alias("validity"), s.alias("smiles"))
