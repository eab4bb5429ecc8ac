"""Project, file and snapshot housekeeping: filters, roll-ups, versions, deletion, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import contains_any, has_text


# --- files -------------------------------------------------------------------------

def classify_files(files: DataFrame) -> DataFrame:
    """File type, document type, discipline and revision from the name."""
    mime = F.col("mime") if "mime" in files.columns else None
    return files.withColumns({
        "extension": X.extension("name"), "file_type": X.file_type(X.extension("name"), mime),
        "document_type": X.document_type("name"), "discipline": X.discipline("name"), "revision": X.revision("name")})


def route_files(files: DataFrame) -> DataFrame:
    """The extractor of each file, or an error text if none takes it."""
    plan = contains_any("document_type", V.PLAN_WORDS)
    t = F.col("file_type")
    route = (F.when(t == "Excel", "table").when(t == "Word", "document").when((t == "PDF") & plan, "plan")
             .when(t == "PDF", "page").when(t == "IFC", "model").when(t == "Image", "scan"))
    return files.withColumn("route", route).withColumn(
        "error", F.when(F.col("route").isNull(), F.concat(F.lit("Dateityp "), t, F.lit(" wird noch nicht unterstützt"))))


def pending(files: DataFrame, done: DataFrame | None = None, ids: Sequence[int] | None = None) -> DataFrame:
    """Files not yet processed, by flag or against a ledger of processed ids."""
    out = files.filter(~F.col("processed")) if done is None else files.join(done.select("file_id"), "file_id", "left_anti")
    return out if ids is None else out.filter(F.col("file_id").isin(list(ids)))


def extracted_counts(entities: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Number of extracted rows per project and entity kind, one column per kind."""
    return entities.groupBy("project_id").pivot("kind", list(kinds)).agg(F.count(F.lit(1))).fillna(0)


def project_status(projects: DataFrame, files: DataFrame) -> DataFrame:
    """All files processed: validated; else any failed: error; else, or without files, processing."""
    roll = files.groupBy("project_id").agg(
        F.bool_and("processed").alias("_all"), F.bool_or(~F.col("processed") & has_text("error")).alias("_bad"))
    joined = projects.select(F.col("id").alias("project_id")).join(roll, "project_id", "left")
    return joined.select("project_id", F.when(F.col("_all"), "validated").when(F.col("_bad"), "error")
                         .otherwise("processing").alias("status"))


def document_statistics(paragraphs: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Paragraph, table and image counts per file in one aggregation."""
    rows = (
        paragraphs.select("file_id", F.lit("p").alias("k"))
        .unionByName(tables.select("file_id", "table_idx").distinct().select("file_id", F.lit("t").alias("k")))
        .unionByName(images.select("file_id", F.lit("i").alias("k")))
    )
    return rows.groupBy("file_id").agg(
        F.count_if(F.col("k") == "p").alias("paragraphs"), F.count_if(F.col("k") == "t").alias("tables"),
        F.count_if(F.col("k") == "i").alias("images")).withColumn("has_images", F.col("images") > 0)


def reconcile(extracted: DataFrame, merged: DataFrame) -> DataFrame:
    """Keys of a file that went missing or shrank in the merge. Both sides: file_id, key, n."""
    both = extracted.select("file_id", "key", F.col("n").alias("extracted")).join(
        merged.select("file_id", "key", F.col("n").alias("merged")), ["file_id", "key"], "full_outer")
    return both.filter(F.col("extracted").isNotNull() & (F.col("merged").isNull() | (F.col("extracted") > F.col("merged")))).withColumn(
        "loss", F.when(F.col("merged").isNull(), "missing").otherwise("shrunk"))


# --- lineage and detail views --------------------------------------------------------------

def entities_by_file(files: DataFrame, lineage: DataFrame) -> DataFrame:
    """Every file with the entities it is a source of; each entity once per file.

    lineage: file_id, entity_kind, entity_id. A file without entities keeps one empty row.
    """
    rows = lineage.select("file_id", "entity_kind", "entity_id").distinct()
    # an inner join can be split on the side of a file with very many entities, an outer one cannot
    return files.join(rows, "file_id").unionByName(
        files.join(rows.select("file_id").distinct(), "file_id", "left_anti"), allowMissingColumns=True)


def explode_sources(entities: DataFrame, kind: str) -> DataFrame:
    return entities.select(F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), F.explode("sources").alias("s")).select(
        "entity_kind", "entity_id", F.col("s.file_id").alias("file_id"))


def project_detail(projects: DataFrame, files: DataFrame, snapshots: DataFrame, issues: DataFrame, reports: DataFrame) -> DataFrame:
    """A project with its children as rows of sections, and counts on the project row."""
    def section(df: DataFrame, name: str, key: Column, label: Column) -> DataFrame:
        return df.select("project_id", F.lit(name).alias("section"), key.cast("string").alias("item"), label.cast("string").alias("label"))

    children = (
        section(files, "file", F.col("file_id"), F.col("name"))
        .unionByName(section(snapshots, "snapshot", F.col("version"), F.col("is_active")))
        .unionByName(section(issues, "issue", F.col("pos"), F.col("rule_id")))
        .unionByName(section(reports, "report", F.col("version"), F.col("report")))
    )
    own = projects.select(F.col("id").alias("project_id"), F.lit("project").alias("section"), F.col("id").cast("string").alias("item"),
                          F.col("name").alias("label"))
    return own.unionByName(children)


def project_detail_counts(projects: DataFrame, detail: DataFrame) -> DataFrame:
    sections = ["file", "snapshot", "issue", "report"]
    counts = detail.groupBy("project_id").agg(*[F.count_if(F.col("section") == s).alias(f"{s}s") for s in sections])
    return projects.select(F.col("id").alias("project_id"), "name").join(counts, "project_id", "left").fillna(0)


def delete_projects(deleted: DataFrame, children: dict[str, DataFrame], key: str = "project_id") -> dict[str, DataFrame]:
    """Drop the rows of deleted projects from every child table."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in children.items()}


# --- snapshots --------------------------------------------------------------------------------

def active_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter("is_active")


def next_versions(snapshots: DataFrame, changed: DataFrame) -> DataFrame:
    """All snapshots after a new version of the changed projects; only the newest is active."""
    top = snapshots.groupBy("project_id").agg(F.max("version").alias("_top"))
    new = changed.select("project_id").distinct().join(top, "project_id", "left").select(
        "project_id", (F.coalesce("_top", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_active"))
    old = snapshots.join(new.select("project_id").withColumn("_new", F.lit(True)), "project_id", "left").withColumn(
        "is_active", F.col("is_active") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new, allowMissingColumns=True)


def latest_flags(snapshots: DataFrame) -> DataFrame:
    """Derive the active flag: the highest version of each project."""
    top = snapshots.groupBy("project_id").agg(F.max("version").alias("_top"))
    return snapshots.join(top, "project_id").withColumn("is_active", F.col("version") == F.col("_top")).drop("_top")


# --- listings -----------------------------------------------------------------------------------

def listing(df: DataFrame, key: str = "id", skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(key).offset(skip).limit(limit)


def write_listing(df: DataFrame, order: Sequence[Column], path: str) -> None:
    """Lay out rows in the given order for listing_page: one range of the order to each partition, and their counts.

    Rows that are equal in `order` are listed in any, but fixed, order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    laid = laid.withColumns({"_part": F.shiftrightunsigned("_row", 33).cast("int"), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)})
    laid.drop("_row").write.partitionBy("_part").parquet(f"{path}/rows")
    spark.read.schema("_part int").parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def listing_page(spark: SparkSession, path: str, schema: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows `skip` + 1 to `skip` + `limit` of a written listing, with their `place` from 1.

    The counts, a number for each partition, say which partitions hold the page: only these are read, however far
    on it is.
    """
    counts = spark.read.schema("_part int, n bigint").parquet(f"{path}/counts").orderBy("_part").collect()
    base, before = {}, 0
    for part, n in counts:
        if before < skip + limit and before + n > skip:
            base[part] = before
        before += n
    rows = spark.read.schema(f"{schema}, _at bigint, _part int").parquet(f"{path}/rows").filter(F.col("_part").isin(list(base)))
    first = F.coalesce(*[F.when(F.col("_part") == part, F.lit(n).cast("long")) for part, n in base.items()], F.lit(0).cast("long"))
    placed = rows.withColumn("place", first + F.col("_at") + 1).drop("_at", "_part")
    return placed.filter((F.col("place") > skip) & (F.col("place") <= skip + limit)).orderBy("place")


def sort_projects(projects: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    """Order by date, or by name, number, location or status in German order; missing text is empty."""
    if field == "date":
        order = F.col("created_at")
    else:
        text = {"name": F.col("name"), "number": X.project_number_line("description"),
                "location": F.col("location"), "status": F.col("status")}[field]
        order = F.collate(F.coalesce(text, F.lit("")), "de")
    return projects.orderBy(order.asc() if ascending else order.desc(), "id")


def without_lineage(df: DataFrame) -> DataFrame:
    return df.drop("sources")


def filled_sections(sections: DataFrame, data: str = "data") -> DataFrame:
    return sections.filter(F.size(data) > 0)


def total_entries(sections: DataFrame, data: str = "data") -> DataFrame:
    return sections.groupBy("project_id").agg(F.sum(F.size(data).cast("long")).alias("entries"))


# --- event logs ------------------------------------------------------------------------------------

def is_error(message: Column) -> Column:
    return contains_any(message, ["error", "failed"])


def is_warning(message: Column) -> Column:
    return contains_any(message, ["warning", "warn"])


def log_summary(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_error(F.col("message"))).alias("errors"),
        F.count_if(is_warning(F.col("message"))).alias("warnings"))
