"""Incremental merge of all entity kinds: each batch of files is matched against stored leaders only.

What a batch adds stands in folders of its own number, below {out}/{kind}/{table}/batch=n/bucket=b; nothing older is
changed. A batch that is run again reads older batches only and overwrites its own folders, so it changes nothing.
The state of any batch can be read (`upto`). Tables:

leaders  keys of the first row of each merged entity: they never change
index    blocks (project, token) of the leaders, by a token order that the first batch fixes
clusters which leader each row has joined
merged   merged entities, a new row whenever a batch touches one
lineage, links, conflicts, values (spaces: which row gave a number), rows (kinds that are not matched)
ledger   the last position of each project and kind

Projects are dealt to BUCKETS buckets by hash; a batch reads the buckets of its own projects only, so its work follows
the projects that it touches and the blocks that it meets, not the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import schema
from plumbline.operators.similarity import greedy_leaders, name_size_ratio, token_order
from plumbline.plans.merge import MATCHING, PROJECT, SURVIVING, Matching, in_arrival_order, with_leaders
from plumbline.session import cut_lineage, free

BUCKETS = 32
NUMBERS = {"spaces": ["area_m2", "volume_m3", "height_m"]}
LINKS = {"systems": ["space_ids", "equipment_ids"]}
ENTITY = ["project_id", "pos"]
_SOURCES = f"array<{schema.SOURCE}>"
_KEYS = {
    "spaces": "id string, guid string, name string, number string", "systems": "id string, guid string, system_guid string, name string",
    "equipment": "id string, guid string, name string, kind string", "milestones": "text string, due string, own bigint"}


def _types(kind: str) -> dict[str, str]:
    """Column types of a kind by name."""
    return {f.name: f.dataType.simpleString() for f in _fields(schema.ENTITIES[kind])}


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def _ddl(kind: str, table: str) -> str:
    if table == "leaders":
        return f"project_id bigint, pos bigint, {_KEYS[kind]}"
    if table == "merged" and kind in SURVIVING:
        types = _types(kind)
        return "project_id bigint, pos bigint, id string, " + ", ".join(f"{f} {types[f]}" for f in SURVIVING[kind]) + ", members bigint"
    if table in ("merged", "rows"):
        return schema.ENTITIES[kind]
    return {
        "index": "project_id bigint, pos bigint, size int, token string",
        "clusters": "project_id bigint, pos bigint, leader bigint",
        "lineage": f"project_id bigint, pos bigint, member_pos bigint, source_idx int, source {schema.SOURCE}",
        "links": "project_id bigint, pos bigint, field string, linked_id string",
        "values": f"project_id bigint, pos bigint, field string, value double, sources {_SOURCES}",
        "conflicts": f"project_id bigint, pos bigint, field string, `old` double, `new` double, old_sources {_SOURCES}, new_sources {_SOURCES}",
        "ledger": "project_id bigint, top bigint, n bigint",
    }[table]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int")


class _Tables:
    """The tables of one kind as a batch sees them: those of older batches, for the buckets that it touches."""

    def __init__(self, spark: SparkSession, out: str, kind: str, before: int | None = None, buckets: Sequence[int] | None = None):
        self.spark, self.root, self.kind, self.before, self.buckets = spark, f"{out}/{kind}", kind, before, buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, table: str) -> DataFrame:
        """The table's columns and `batch`."""
        ddl = f"{_ddl(self.kind, table)}, batch bigint, bucket int"
        if not self.exists(table):
            return self.spark.createDataFrame([], ddl).drop("bucket")
        rows = self.spark.read.schema(ddl).parquet(self.path(table))
        if self.before is not None:
            rows = rows.filter(F.col("batch") < self.before)
        if self.buckets is not None:
            rows = rows.filter(F.col("bucket").isin(list(self.buckets)))
        return rows.drop("bucket")

    def newest(self, table: str, key: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
        """The row of each key that the last batch wrote, for the keys of `wanted` (project_id, pos) or all."""
        rows = self.read(table)
        if wanted is not None:
            rows = rows.join(wanted, ENTITY, "left_semi")
        values = [c for c in rows.columns if c not in (*key, "batch")]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*key, "_v.*")

    def write(self, table: str, batch_id: int, rows: DataFrame) -> None:
        dealt = rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path(table)}/batch={batch_id}")


def _buckets_of(rows: DataFrame) -> list[int]:
    """Which of the BUCKETS buckets the rows' projects are in."""
    return sorted(r[0] for r in rows.select(_bucket().alias("b")).distinct().collect())


def _positions(tables: _Tables, rows: DataFrame, batch_id: int, file_order: str) -> DataFrame:
    """The batch's rows with positions after those of older batches; a written table. Adds to the ledger."""
    top = tables.read("ledger").groupBy("project_id").agg((F.max("top") + 1).alias("_base"))
    placed = in_arrival_order(None, rows, file_order).join(top, "project_id", "left").withColumn(
        "pos", F.col("pos") + F.coalesce("_base", F.lit(0))).drop("_base")
    placed = cut_lineage(placed, "placed")
    tables.write("ledger", batch_id, placed.groupBy("project_id").agg(F.max("pos").alias("top"), F.count(F.lit(1)).alias("n")))
    return placed


def _fixed_order(tables: _Tables, items: DataFrame, name: str, batch_id: int) -> DataFrame:
    """The token order of the oldest batch that had one; this batch's, if there is none."""
    spark, ddl = tables.spark, "token string, _n bigint, batch bigint"
    if tables.exists("order"):
        first = spark.read.schema(ddl).parquet(tables.path("order")).filter(F.col("batch") < batch_id).agg(F.min("batch")).first()[0]
        if first is not None:
            return spark.read.schema(ddl).parquet(tables.path("order")).filter(F.col("batch") == first).drop("batch")
    names = items.filter(F.length(name) > 0).select(name).distinct()
    path = f"{tables.path('order')}/batch={batch_id}"
    token_order(names, name).write.mode("overwrite").parquet(path)
    return spark.read.schema("token string, _n bigint").parquet(path)


def _known_leaders(tables: _Tables, m: Matching, items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(project_id, pos, leader): the earliest stored leader that an item matches."""
    index = tables.read("index").select("project_id", "token", F.col("pos").alias("_old"), F.col("size").alias("_osize"))
    ratio = name_size_ratio(m.threshold)
    fits = F.least("size", "_osize") > F.lit(ratio) * F.greatest("size", "_osize") - F.lit(1e-9)
    near = blocks.join(index, ["project_id", "token"]).filter(F.col("size").isNull() | F.col("_osize").isNull() | fits).select(
        *ENTITY, "_old").distinct()
    old = tables.read("leaders").select("project_id", F.col("pos").alias("_old"), F.struct(*m.columns).alias("_o"))
    new = items.select(*ENTITY, F.struct(*m.columns).alias("_n"))
    both = near.join(new, ENTITY).join(old, ["project_id", "_old"])
    hits = both.filter(m.matches(lambda c: F.col("_n")[c], lambda c: F.col("_o")[c]))
    return hits.groupBy(*ENTITY).agg(F.min("_old").alias("leader"))


def _merge_kind(tables: _Tables, rows: DataFrame, batch_id: int) -> None:
    """Match the rows of one kind, and write what the batch adds.

    Stored leaders stand before all rows of the batch, so a row joins the earliest of them that it matches; the rows
    that match none go through the greedy pass among themselves. Together this is the sequential pass.
    """
    kind, m = tables.kind, MATCHING[tables.kind]()
    keys = m.keys(rows)
    items = cut_lineage(keys.groupBy("project_id", *m.columns).agg(F.min("pos").alias("pos")), "items")
    blocks = cut_lineage(m.blocks(items, _fixed_order(tables, items, m.name, batch_id)), "blocks")
    known = cut_lineage(_known_leaders(tables, m, items, blocks), "known")
    rest = items.join(known, ENTITY, "left_anti")
    led = cut_lineage(greedy_leaders(rest, blocks.join(rest.select(*ENTITY), ENTITY, "left_semi"), PROJECT, "pos", list(m.columns),
                                     m.matches, name_size_ratio(m.threshold)), "led")
    clusters = cut_lineage(with_leaders(keys, items, known.unionByName(led), m.columns), "clusters")
    fresh = led.filter("pos = leader").select(*ENTITY)
    tables.write("leaders", batch_id, items.join(fresh, ENTITY, "left_semi").select(*ENTITY, *m.columns))
    tables.write("index", batch_id, blocks.join(fresh, ENTITY, "left_semi").select(*ENTITY, F.col("size").cast("int").alias("size"), "token"))
    tables.write("clusters", batch_id, clusters)

    joined = rows.join(clusters, ENTITY)
    touched = clusters.select("project_id", F.col("leader").alias("pos")).distinct()
    lead = F.col("leader").alias("pos")
    tables.write("lineage", batch_id, joined.select(
        "project_id", lead, F.col("pos").alias("member_pos"), F.posexplode("sources").alias("source_idx", "source")))
    if kind in SURVIVING:
        tables.write("merged", batch_id, _survivors(tables, joined, touched))
    else:  # only the sources of a matched row are kept
        tables.write("merged", batch_id, rows.join(clusters.filter("pos = leader"), ENTITY, "left_semi").select(*_types(kind)))
    if kind in LINKS:
        pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ids")) for f in LINKS[kind]]))
        tables.write("links", batch_id, joined.select("project_id", lead, pairs).select(
            *ENTITY, "field", F.explode("ids").alias("linked_id")).distinct())
    if kind in NUMBERS:
        _write_conflicts(tables, joined, touched, batch_id)
    free(items, blocks, known, led, clusters)


def _survivors(tables: _Tables, joined: DataFrame, touched: DataFrame) -> DataFrame:
    """The touched entities: id of the leader, per field the first value that is not null, from older batches first."""
    fields = SURVIVING[tables.kind]
    old = tables.newest("merged", ENTITY, touched).withColumn("leader", F.col("pos"))
    both = old.unionByName(joined.select(*ENTITY, "leader", "id", *fields, F.lit(1).cast("long").alias("members")))
    return both.groupBy("project_id", "leader").agg(
        F.min_by("id", "pos").alias("id"), *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields],
        F.sum("members").alias("members")).withColumnRenamed("leader", "pos")


def _write_conflicts(tables: _Tables, joined: DataFrame, touched: DataFrame, batch_id: int, tolerance: float = 0.01) -> None:
    """Numbers that differ from the surviving value; the last one per field stays."""
    key = [*ENTITY, "field"]
    numbers = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in NUMBERS[tables.kind]]))
    given = joined.select("project_id", F.col("leader").alias("pos"), F.col("pos").alias("member"), "sources", numbers).filter("value is not null")
    old = tables.read("values").drop("batch").join(touched, ENTITY, "left_semi")
    first = given.groupBy(*key).agg(F.min_by(F.struct("value", "sources"), "member").alias("f")).join(old, key, "left_anti").select(*key, "f.*")
    tables.write("values", batch_id, first)
    kept = old.unionByName(first).withColumnsRenamed({"value": "old", "sources": "old_sources"})
    differ = given.join(kept, key).filter(F.abs(F.col("value") - F.col("old")) > tolerance)
    last = F.struct("old", F.col("value").alias("new"), "old_sources", F.col("sources").alias("new_sources"))
    tables.write("conflicts", batch_id, differ.groupBy(*key).agg(F.max_by(last, "member").alias("c")).select(*key, "c.*"))


def merge_batch(spark: SparkSession, out: str, batch_id: int, entities: Mapping[str, DataFrame], file_order: str = "file_id") -> None:
    """Merge a batch of rows of any kinds into the model below `out`.

    entities: kind -> rows with project_id, the column `file_order`, pos (order within the file) and the columns of
    the kind. Kinds without matching rules are appended. A batch without rows of a kind leaves that kind as it is.
    Rows without project_id belong to no model and are left out. No kind reads another's tables, so their many small
    jobs run side by side.
    """
    def merge(kind: str) -> None:
        rows = cut_lineage(entities[kind].filter("project_id is not null"), "batch")
        buckets = _buckets_of(rows)
        tables = _Tables(spark, out, kind, batch_id, buckets)
        if not buckets:
            free(rows)
            return
        placed = _positions(tables, rows, batch_id, file_order)
        if kind in MATCHING:
            _merge_kind(tables, placed, batch_id)
        else:
            tables.write("rows", batch_id, placed.select(*_types(kind)))
            tables.write("lineage", batch_id, placed.select(
                *ENTITY, F.col("pos").alias("member_pos"), F.posexplode("sources").alias("source_idx", "source")))
        free(rows, placed)

    if not entities:
        return
    with ThreadPoolExecutor(len(entities)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(merge), kind) for kind in entities]:
            done.result()


def merged_model(spark: SparkSession, out: str, kind: str, upto: int | None = None) -> dict[str, DataFrame]:
    """The merged rows of one kind with lineage, clusters, links and conflicts, after batch `upto` or the last one."""
    tables = _Tables(spark, out, kind, None if upto is None else upto + 1)
    state = {"lineage": tables.read("lineage").drop("batch")}
    if kind not in MATCHING:
        return state | {"merged": tables.read("rows").drop("batch")}
    state["clusters"] = tables.read("clusters").drop("batch")
    state["merged"] = tables.newest("merged", ENTITY) if kind in SURVIVING else tables.read("merged").drop("batch")
    if kind in LINKS:
        state["links"] = tables.read("links").drop("batch").distinct()
    if kind in NUMBERS:
        state["conflicts"] = tables.newest("conflicts", [*ENTITY, "field"])
    return state


def project_versions(spark: SparkSession, out: str, kinds: Sequence[str] = tuple(schema.ENTITIES), upto: int | None = None) -> DataFrame:
    """(project_id, version): how many batches have touched each project."""
    seen = None
    for kind in kinds:
        tables = _Tables(spark, out, kind, None if upto is None else upto + 1)
        here = tables.read("ledger").select("project_id", "batch")
        seen = here if seen is None else seen.unionByName(here)
    return seen.groupBy("project_id").agg(F.countDistinct("batch").alias("version"))


def split_kinds(rows: DataFrame, kinds: Sequence[str], extra: Sequence[str] = ("file_id",)) -> dict[str, DataFrame]:
    """Rows of all kinds in one table, told apart by `entity`, as one table for each kind. Columns that a kind lacks are null."""
    out = {}
    for kind in kinds:
        have = set(rows.columns)
        columns = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in _types(kind).items()]
        out[kind] = rows.filter(F.col("entity") == kind).select(*columns, *extra)
    return out


def model_stream(rows: DataFrame, out: str, checkpoint: str, kinds: Sequence[str] = tuple(schema.ENTITIES),
                 file_order: str = "file_id") -> StreamingQuery:
    """Merge each micro-batch of rows of all kinds (column `entity`) into the model below `out`; stops when all is read."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch, "arrived")
        merge_batch(batch.sparkSession, out, batch_id, split_kinds(batch, kinds, (file_order,)), file_order)
        free(batch)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
