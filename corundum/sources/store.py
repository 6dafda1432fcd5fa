"""The evidence store: tables in buckets of documents behind a log of commits, and exports.

A document's rows lie in the bucket of its hashed id; the number of buckets is fixed when a store is
begun. A change names the documents that it replaces: their old rows go, whether new ones come or not,
and a change that is repeated leaves the same store. It rewrites only the buckets of these documents, to
folders of its own, and becomes visible in all tables at once by its commit.

Writers may run at the same time. One that finds its version taken looks at what the others changed: if
that is other buckets, its own go on top of theirs, else its change is made again on their rows. A reader
keeps the version that it began with. Tables are read with their schema, never inferred."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corundum.schemas import TABLES
from corundum.sources.commits import CommitLog, Snapshot, Taken
from corundum.sources.folders import names_in, remove, scratch, settled

BUCKETS = 256
BUCKET = "doc_bucket"
#: Attempts of a change whose rows others change meanwhile.
ATTEMPTS = 20
#: What a document's reset removes besides its table rows.
OF_DOCUMENT = ("structure_detections", "ocr_blocks", "visual_tasks", "figures", "tables", "evidence_blocks", "pages", "files", "diagnostics", "documents")
#: The evidence that each table of the agents is told by.
AGENT_TABLES = {
    "agent_table_measurements": "agent_table_measurement", "agent_compound_links": "agent_compound_link",
    "agent_conflict_decisions": "agent_conflict_decision", "agent_scaffold_resolutions": "agent_scaffold_resolution",
}


class View:
    """The store at one version."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, snapshot: Snapshot):
        self.spark, self.folder, self.buckets, self.tables = spark, folder, buckets, {t: dict(b) for t, b in snapshot.tables.items()}
        self.version = snapshot.version

    def bucket_of(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def schema(self, table: str) -> StructType:
        if table not in TABLES:
            raise ValueError(f"no table {table!r}; there are {', '.join(TABLES)}")
        return StructType.fromDDL(TABLES[table])

    def exists(self, table: str) -> bool:
        self.schema(table)
        return table in self.tables

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """The table, or those buckets of it; an empty one if there is none."""
        schema = self.schema(table)
        paths = [f"{self.folder}/data/{f}" for b, f in sorted(self.tables.get(table, {}).items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        return self.spark.read.schema(schema).parquet(*paths)

    def attach_rows(self, rows: DataFrame, evidence: DataFrame) -> DataFrame:
        """Table rows whose evidence is there."""
        return rows.join(evidence.select("doc_id", "evidence_id").distinct(), ["doc_id", "evidence_id"], "left_semi")

    def counts(self, docs: DataFrame) -> DataFrame:
        """doc_id, source_type, n of evidence."""
        return self.read("evidence_blocks").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "source_type").agg(F.count("*").alias("n"))

    def table_counts(self, *tables: str) -> DataFrame:
        """table_name, n; 0 for a table that isn't there."""
        of = lambda t: self.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        return reduce(DataFrame.unionAll, map(of, tables or tuple(TABLES)))

    def latest_document(self) -> DataFrame:
        """The document that was filed last: doc_id, source_path."""
        return self.read("documents").orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(1).select("doc_id", "source_path")


class Change(View):
    """A view that can be changed, and that sees its own changes; nobody else does before its commit.
    What it is given to write is written once, however often the change is made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, snapshot: Snapshot, room: str, given: dict[int, tuple]):
        super().__init__(spark, folder, buckets, snapshot)
        self.room, self.given, self.touched = room, given, set()

    def _given(self, df: DataFrame) -> DataFrame:
        """df as it was when it was first given, if it doesn't depend on the store."""
        if id(df) not in self.given:
            self.given[id(df)] = (df, settled(df, f"{self.room}/given{len(self.given)}"))  # df is held, so that its id stays its own
        return self.given[id(df)][1]

    def replace(self, table: str, df: DataFrame, docs: DataFrame) -> None:
        """The rows of docs (a column doc_id) go, df comes. Columns that df lacks are null; those that
        the table lacks are left out."""
        full = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(table)))
        own = f"{self.room}/{uuid.uuid4().hex}"
        new = settled(full, f"{own}-new")
        replaced = settled(docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), f"{own}-docs")
        touched = {r[0] for r in replaced.union(new.select("doc_id")).select(self.bucket_of(F.col("doc_id"))).distinct().collect()}  # as many as there are buckets
        if not touched:
            return
        old = self.read(table, touched)
        kept = old.join(replaced, old["doc_id"].eqNullSafe(replaced["doc_id"]), "left_anti")
        merged = kept.unionByName(new).withColumn(BUCKET, self.bucket_of(F.col("doc_id")))
        data = f"{table}/{uuid.uuid4().hex}"
        # Small buckets share a task, a large one is dealt to several.
        merged.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{data}")
        filled = {int(n.removeprefix(f"{BUCKET}=")) for n in names_in(self.spark, f"{self.folder}/data/{data}") if n.startswith(BUCKET)}
        buckets = self.tables.setdefault(table, {})
        for b in touched:
            buckets.pop(b, None)
        buckets |= {b: f"{data}/{BUCKET}={b}" for b in filled}
        self.touched |= {(table, b) for b in touched}

    def write(self, table: str, df: DataFrame, docs: DataFrame | None = None) -> None:
        """Replace what the table has of docs (as a rule those of df) by df."""
        new = self._given(df)
        self.replace(table, new, new if docs is None else self._given(docs))

    def upsert(self, table: str, df: DataFrame, key: str) -> None:
        """Rows of df in place of those with the same document and key; the document's others stay."""
        new = self._given(df)
        keys = new.select("doc_id", key).distinct()
        old = self.read(table).join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        self.replace(table, old.join(keys, ["doc_id", key], "left_anti").unionByName(new, allowMissingColumns=True), keys)

    def clear(self, table: str, docs: DataFrame, **having: str) -> None:
        """Remove the documents' rows that have all these values, all their rows if none is given. A
        null isn't such a value: its row stays."""
        names = self._given(docs).select("doc_id").distinct()
        gone = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in having.items()), F.lit(True))
        self.replace(table, self.read(table).join(names, "doc_id", "left_semi").where(~gone), names)

    def reset(self, docs: DataFrame) -> None:
        """Remove all that the store has of documents: rows of their tables or with their evidence
        first, whichever document these rows are filed under."""
        names = self._given(docs).select("doc_id").distinct()
        rows = self.read("table_rows")
        tables = self.read("tables").join(names, "doc_id", "left_semi").select("table_id").distinct()
        blocks = self.read("evidence_blocks").join(names, "doc_id", "left_semi").select("evidence_id").distinct()
        gone = rows.join(tables, "table_id", "left_semi").select("doc_id", "row_id").union(rows.join(blocks, "evidence_id", "left_semi").select("doc_id", "row_id")).distinct()
        gone = settled(gone, f"{self.room}/{uuid.uuid4().hex}-gone")
        kept = rows.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").join(gone, ["doc_id", "row_id"], "left_anti")
        self.replace("table_rows", kept, gone)
        for table in OF_DOCUMENT:
            if self.exists(table):
                self.clear(table, docs)

    def put_document(self, parts: dict[str, DataFrame], docs: DataFrame) -> None:
        """A scrape again: what the store has of docs goes, parts (table: rows) come. Table rows are
        taken only with their evidence."""
        self.reset(docs)
        for table, df in sorted(parts.items(), key=lambda x: x[0] == "table_rows"):  # table rows after their evidence
            new = self._given(df)
            self.replace(table, self.attach_rows(new, self.read("evidence_blocks")) if table == "table_rows" else new, self._given(docs))

    def put_agents(self, tables: dict[str, DataFrame], evidence: DataFrame, docs: DataFrame) -> None:
        """What the agents found of docs, in place of what they found before; evidence are its blocks."""
        for table, df in tables.items():
            self.write(table, df, docs)
        names = self._given(docs).select("doc_id").distinct()
        kinds = [AGENT_TABLES[t] for t in tables]
        old = self.read("evidence_blocks").join(names, "doc_id", "left_semi").where(~F.coalesce(F.col("source_type").isin(*kinds), F.lit(False)))
        self.replace("evidence_blocks", old.unionByName(self._given(evidence), allowMissingColumns=True), names)


class EvidenceStore:
    """Reads are of the latest version; at() holds one. Each change is a commit of its own; commit()
    makes one of several."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.log = CommitLog(spark, self.folder)

    def at(self, version: int | None = None) -> View:
        return View(self.spark, self.folder, self.buckets, self.log.latest() if version is None else self.log.read(version))

    def commit(self, change: Callable[[Change], None]) -> int:
        """Make a change and commit it; again on the rows of others that changed the same buckets.
        What change is given must not depend on the store but by what it reads itself. Returns the version."""
        room, given = scratch(self.spark), {}
        base, done = self.log.latest(), None
        for _ in range(ATTEMPTS):
            if done is None:
                done = Change(self.spark, self.folder, self.buckets, base, room, given)
                read_at = base.version
                change(done)
            if not done.touched:
                remove(self.spark, room)
                return base.version
            tables = {t: dict(b) for t, b in base.tables.items()}
            for t, b in done.touched:
                tables.setdefault(t, {}).pop(b, None)
                if b in done.tables.get(t, {}):
                    tables[t][b] = done.tables[t][b]
            try:
                self.log.put(Snapshot(base.version + 1, tables, frozenset(done.touched)))
                remove(self.spark, room)
                return base.version + 1
            except Taken:
                base = self.log.latest()
                # Rows of a bucket may depend on what the change read of it in any table.
                if {b for _, b in self.log.changed_since(read_at)} & {b for _, b in done.touched}:
                    done = None
        raise RuntimeError("others change the same rows all the time")

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Remove versions but the last, and data that none of these has."""
        return self.log.vacuum(f"{self.folder}/data", keep, hours)

    def write(self, table: str, df: DataFrame, docs: DataFrame | None = None) -> None:
        self.commit(lambda x: x.write(table, df, docs))

    def upsert(self, table: str, df: DataFrame, key: str) -> None:
        self.commit(lambda x: x.upsert(table, df, key))

    def clear(self, table: str, docs: DataFrame, **having: str) -> None:
        self.commit(lambda x: x.clear(table, docs, **having))

    def reset(self, docs: DataFrame) -> None:
        self.commit(lambda x: x.reset(docs))

    def put_document(self, parts: dict[str, DataFrame], docs: DataFrame) -> None:
        self.commit(lambda x: x.put_document(parts, docs))

    def put_agents(self, tables: dict[str, DataFrame], evidence: DataFrame, docs: DataFrame) -> None:
        self.commit(lambda x: x.put_agents(tables, evidence, docs))

    def read(self, table: str) -> DataFrame:
        return self.at().read(table)

    def exists(self, table: str) -> bool:
        return self.at().exists(table)

    def counts(self, docs: DataFrame) -> DataFrame:
        return self.at().counts(docs)

    def table_counts(self, *tables: str) -> DataFrame:
        return self.at().table_counts(*tables)

    def latest_document(self) -> DataFrame:
        return self.at().latest_document()

    def attach_rows(self, rows: DataFrame, evidence: DataFrame) -> DataFrame:
        return self.at().attach_rows(rows, evidence)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs as JSON."""
    flat = [F.col(f"`{f.name}`") if f.dataType.typeName() in ("string", "integer", "long", "double", "boolean") else F.to_json(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
