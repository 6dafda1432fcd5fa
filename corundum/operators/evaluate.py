"""Score predicted records against true ones: multiset precision, recall and F1 a column, averaged
over articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.values import ARTICLE_COLUMNS, clean_article, decimal_point, pdf_identifier
from corundum.schemas import MISSING, Domain

OPEN = ("1", "1.0", "true", "True")


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def prepare_truth(d: Domain, frame: DataFrame) -> DataFrame:
    """Decimal points, unquoted relations, open articles only (if any is), an article id in pdf, no
    nulls. All values are text: reading truth as text keeps 4 apart from 4.0."""
    out = frame
    for c in d.columns:
        if c in d.numeric and c in out.columns:
            out = out.withColumn(c, decimal_point(_text(c)))
    if d.key in ("oxazolidinone", "benzimidazole") and "target_relation" in out.columns:
        out = out.withColumn("target_relation", F.when(_text("target_relation") == "'='", "=").otherwise(_text("target_relation")))
    if "access" in out.columns:
        is_open = F.trim(_text("access")).isin(*OPEN)
        any_open = out.agg(F.max(is_open.cast("int")).alias("any_open"))  # one row
        out = out.crossJoin(F.broadcast(any_open)).where((F.coalesce("any_open", F.lit(0)) == 0) | is_open).drop("any_open")
    ids = [c for c in ARTICLE_COLUMNS.get(d.key, ("pdf",)) if c in out.columns]
    if "pdf" not in out.columns or d.key in ARTICLE_COLUMNS:
        known = [F.when(clean_article(_text(c)) != MISSING, pdf_identifier(d, clean_article(_text(c)))) for c in ids]
        out = out.withColumn("pdf", F.coalesce(*known, F.lit(MISSING)))
    return _filled(d, out)


def prepare_prediction(d: Domain, frame: DataFrame) -> DataFrame:
    """Columns by their own names or an alias, missing ones added, article ids, decimal points, no
    nulls."""
    out = frame
    for source, target in d.aliases.items():
        if source in out.columns and target not in out.columns:
            out = out.withColumnRenamed(source, target)
    if "pdf" in out.columns:
        out = out.withColumn("pdf", pdf_identifier(d, F.coalesce(_text("pdf"), F.lit("nan"))))
    else:
        out = out.withColumn("pdf", F.lit(MISSING))
    for c in d.columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(MISSING))
        elif c in d.numeric:
            out = out.withColumn(c, decimal_point(_text(c)))
    return _filled(d, out)


def _filled(d: Domain, frame: DataFrame) -> DataFrame:
    have = [c for c in (*d.columns, "pdf") if c in frame.columns]
    return frame.withColumns({c: F.coalesce(_text(c), F.lit(MISSING)) for c in have})


def _cells(frame: DataFrame, columns: list[str], article: str, side: str) -> DataFrame:
    """article, column and value of each cell, counted; one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(_text(c), F.lit(MISSING)).alias("value")) for c in columns))
    cells = frame.select(F.lower(_text(article)).alias("article"), F.explode(pairs).alias("cell"))
    return cells.select("article", "cell.column", "cell.value", F.lit(int(side == "true")).alias("t"), F.lit(int(side == "pred")).alias("p"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def article_metrics(truth: DataFrame, pred: DataFrame, columns: list[str], *, article: str = "pdf") -> DataFrame:
    """article, column, tp, fp, fn, precision, recall and f1, for every article and column either
    side has. Both sides are unpivoted and summed by value in one shuffle."""
    counts = _cells(truth, columns, article, "true").unionAll(_cells(pred, columns, article, "pred")).groupBy("article", "column", "value").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    tp, fp, fn = F.least("t", "p"), F.greatest(F.col("p") - F.col("t"), F.lit(0)), F.greatest(F.col("t") - F.col("p"), F.lit(0))
    sums = counts.groupBy("article", "column").agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    c = F.col
    sums = sums.withColumn("precision", _ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", _ratio(c("tp"), c("tp") + c("fn")))
    return sums.withColumn("f1", _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def evaluate(truth: DataFrame, pred: DataFrame, columns: list[str], *, article: str = "pdf", articles: DataFrame | None = None) -> DataFrame:
    """One row a column: tp, fp, fn, precision, recall and f1 as means over articles. Articles are
    those of the truth, or the given ones (a column article; repeated ones count as often); what is
    predicted for others is left out."""
    wanted = truth.select(F.lower(_text(article)).alias("article")).distinct() if articles is None else articles.select(F.lower(F.col("article").cast("string")).alias("article"))
    weight = wanted.groupBy("article").agg(F.count("*").alias("times"))
    total = weight.agg(F.sum("times").alias("n"))  # one row
    per = article_metrics(truth, pred, columns, article=article).join(weight, "article")
    names = ("tp", "fp", "fn", "precision", "recall", "f1")
    sums = per.groupBy("column").agg(*(F.sum(F.col(m) * F.col("times")).alias(m) for m in names))
    grid = truth.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = grid.join(F.broadcast(sums), "column", "left").crossJoin(F.broadcast(total))  # a row a column
    return found.select("column", *(F.coalesce(F.try_divide(F.col(m), F.col("n")), F.lit(0.0)).alias(m) for m in names))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
