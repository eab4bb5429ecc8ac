"""Entity resolution: match, survive, keep conflicts and lineage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.predicates import has_text
from plumbline.operators.ordered import dense_ranks
from plumbline.operators.similarity import greedy_leaders, name_blocks, name_size_ratio, ratio_above
from plumbline.session import cut_lineage

PROJECT = ["project_id"]


def _lower(c: str) -> Column:
    return F.coalesce(F.lower(F.col(c)), F.lit(""))


def _tag(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)


def _equal_blocks(rows: DataFrame, tokens: Sequence[Column]) -> DataFrame:
    """One block per key value; null tokens make none."""
    kept = F.filter(F.array(*tokens), lambda x: x.isNotNull())
    return rows.select("project_id", "pos", F.lit(None).cast("int").alias("size"), F.explode(kept).alias("token"))


def _text_blocks(rows: DataFrame, name: str, threshold: float, within: str | None = None, order: DataFrame | None = None) -> DataFrame:
    """Blocks of the distinct names, given to every row with the name."""
    scope = PROJECT if within is None else [*PROJECT, within]
    names = rows.filter(F.length(name) > 0).select(*scope, name).distinct()
    found = name_blocks(names, scope, name, name, threshold, order)
    token = _tag("t:", F.col("token")) if within is None else F.concat_ws("|", F.lit("t"), within, "token")
    return found.select(*scope, name, "size", token.alias("token")).join(
        rows.select(*scope, name, "pos"), [*scope, name]).select("project_id", "pos", "size", "token")


def _without_lone(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids and guids that occur once in their project match nothing, so named rows go without them.

    Rows that differ in lone keys only then count as one. A row without a name keeps its
    id, since its equals would match it by nothing else.
    """
    for key in ("id", "guid", "system_guid"):
        if key in keys:
            shared = rows.groupBy("project_id", key).agg(F.count(F.lit(1)).alias("_n")).filter(
                (F.col("_n") > 1) & F.col(key).isNotNull()).select("project_id", key, F.lit(True).alias("_shared"))
            lone = has_text("name") & F.col("project_id").isNotNull() & F.col(key).isNotNull() & F.col("_shared").isNull()
            rows = rows.join(shared, ["project_id", key], "left")
            if key == "id":
                rows = rows.withColumn("lone", lone)
            rows = rows.withColumn(key, F.when(~lone, F.col(key))).drop("_shared")
    return cut_lineage(rows)


@dataclass(frozen=True)
class Matching:
    """How rows of one kind match: their keys, the blocks in which they meet, and the test of a pair.

    `keys` selects project_id, pos and the key columns; `name` is the key that is compared by ratio. `blocks` gets
    rows of keys and, for blocks that have to fit those of other rows, a written token order.
    """

    threshold: float
    name: str
    columns: tuple[str, ...]
    keys: Callable[[DataFrame], DataFrame]
    blocks: Callable[[DataFrame, DataFrame | None], DataFrame]
    matches: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def with_leaders(rows: DataFrame, items: DataFrame, led: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(project_id, pos, leader): every row gets the leader of the item with its keys."""
    cond = [F.col("a.project_id").eqNullSafe(F.col("b.project_id"))] + [
        F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    named = items.join(led, ["project_id", "pos"]).drop("pos")
    return rows.alias("a").join(named.alias("b"), cond).select("a.project_id", "a.pos", "b.leader")


def _clusters(entities: DataFrame, m: Matching) -> DataFrame:
    """(project_id, pos, leader). Rows with equal keys count once: the first stands for all."""
    rows, keys = m.keys(entities), list(m.columns)
    if "id" in keys:
        rows, keys = _without_lone(rows, keys), [*keys, "lone"]
    distinct = rows.groupBy("project_id", *keys).agg(F.min("pos").alias("pos"))
    items = distinct
    if "id" in keys:
        # a lone id is no missing id, and missing ids equal each other
        items = distinct.withColumn("id", F.when(F.col("lone"), F.concat(F.lit("\1"), F.col("pos").cast("string"))).otherwise(F.col("id")))
    led = greedy_leaders(items, m.blocks(items, None), PROJECT, "pos", keys, m.matches, name_size_ratio(m.threshold))
    return with_leaders(rows, distinct, led, keys)


def _same_text(new, old, key: str) -> Column:
    return has_text(new(key)) & new(key).eqNullSafe(old(key))


def _near_names(new, old, key: str, threshold: float) -> Column:
    return has_text(new(key)) & has_text(old(key)) & ratio_above(new(key), old(key), threshold)


def _key_block(prefix: str, key: str) -> Column:
    return F.when(has_text(key), _tag(prefix, F.col(key)))


def _id_block() -> Column:
    """Rows without id have one in common."""
    return _tag("i:", F.coalesce("id", F.lit("\0")))


def _space_matching() -> Matching:
    """Same id, guid, name or number, or a name ratio above 0.8."""
    return Matching(
        0.8, "name", ("id", "guid", "name", "number"),
        lambda s: s.select("project_id", "pos", "id", "guid", _lower("name").alias("name"), _lower("number").alias("number")),
        lambda r, order: _equal_blocks(r, [_id_block(), _key_block("u:", "guid"), _key_block("n:", "number")]).unionByName(
            _text_blocks(r, "name", 0.8, order=order)),
        lambda new, old: new("id").eqNullSafe(old("id")) | _same_text(new, old, "guid") | _same_text(new, old, "number")
        | _near_names(new, old, "name", 0.8))


def _system_matching() -> Matching:
    """Same id, guid or system guid, or a name ratio above 0.8."""
    return Matching(
        0.8, "name", ("id", "guid", "system_guid", "name"),
        lambda s: s.select("project_id", "pos", "id", "guid", "system_guid", _lower("name").alias("name")),
        lambda r, order: _equal_blocks(r, [_id_block(), _key_block("u:", "guid"), _key_block("s:", "system_guid")]).unionByName(
            _text_blocks(r, "name", 0.8, order=order)),
        lambda new, old: new("id").eqNullSafe(old("id")) | _same_text(new, old, "guid") | _same_text(new, old, "system_guid")
        | _near_names(new, old, "name", 0.8))


def _equipment_matching() -> Matching:
    """Same id, guid or name; or the same kind and a name ratio above 0.7, where two empty names are alike."""
    return Matching(
        0.7, "name", ("id", "guid", "name", "kind"),
        lambda e: e.select("project_id", "pos", "id", "guid", _lower("name").alias("name"), _lower("kind").alias("kind")),
        lambda r, order: _equal_blocks(r, [
            _id_block(), _key_block("u:", "guid"), _key_block("n:", "name"),
            F.when(~has_text("name") & has_text("kind"), _tag("e:", F.col("kind"))),
        ]).unionByName(_text_blocks(r.filter(has_text("kind")), "name", 0.7, within="kind", order=order)),
        lambda new, old: new("id").eqNullSafe(old("id")) | _same_text(new, old, "guid") | _same_text(new, old, "name")
        | (_same_text(new, old, "kind") & ratio_above(new("name"), old("name"), 0.7)))


def _milestone_matching() -> Matching:
    """Text ratio above 0.9 and the same due date; no date equals no date."""
    def keys(milestones: DataFrame) -> DataFrame:
        rows = milestones.select("project_id", "pos", _lower("text").alias("text"), F.coalesce("due", F.lit("\0")).alias("due"))
        # a milestone without text matches nothing, not even its copy
        return rows.withColumn("own", F.when(~has_text("text"), F.col("pos")))

    return Matching(
        0.9, "text", ("text", "due", "own"), keys,
        lambda r, order: _text_blocks(r, "text", 0.9, within="due", order=order),
        lambda new, old: (new("due") == old("due")) & _near_names(new, old, "text", 0.9))


MATCHING = {"spaces": _space_matching, "systems": _system_matching, "equipment": _equipment_matching, "milestones": _milestone_matching}


def space_clusters(spaces: DataFrame) -> DataFrame:
    return _clusters(spaces, _space_matching())


def system_clusters(systems: DataFrame) -> DataFrame:
    return _clusters(systems, _system_matching())


def equipment_clusters(equipment: DataFrame) -> DataFrame:
    return _clusters(equipment, _equipment_matching())


def milestone_clusters(milestones: DataFrame) -> DataFrame:
    return _clusters(milestones, _milestone_matching())


# --- merge of matched rows --------------------------------------------------------

def survivors(rows: DataFrame, clusters: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per cluster: id of the leader, per field the first value that is not null."""
    joined = rows.join(clusters, ["project_id", "pos"])
    fields = [f for f in fields if f in rows.columns]
    return joined.groupBy("project_id", F.col("leader").alias("pos")).agg(
        F.min_by("id", "pos").alias("id"),
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields],
        F.count(F.lit(1)).alias("members"))


def conflicts(rows: DataFrame, clusters: DataFrame, fields: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Numbers that differ from the surviving value; the last one per field stays."""
    long = rows.join(clusters, ["project_id", "pos"]).select(
        "project_id", "leader", "pos", "sources",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    ).filter("value is not null")
    kept = long.groupBy("project_id", "leader", "field").agg(
        F.min_by(F.struct(F.col("value").alias("old"), F.col("sources").alias("old_sources")), "pos").alias("kept"))
    return (
        long.join(kept, ["project_id", "leader", "field"])
        .filter(F.abs(F.col("value") - F.col("kept.old")) > tolerance)
        .groupBy("project_id", "leader", "field")
        .agg(F.max_by(F.struct(
            F.col("kept.old").alias("old"), F.col("value").alias("new"),
            F.col("kept.old_sources").alias("old_sources"), F.col("sources").alias("new_sources")), "pos").alias("c"))
        .select("project_id", F.col("leader").alias("pos"), "field", "c.*")
    )


def lineage(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """All sources of a merged entity as rows in order; a cluster may hold any number of them."""
    return rows.join(clusters, ["project_id", "pos"]).select(
        "project_id", F.col("leader").alias("pos"), F.col("pos").alias("member_pos"),
        F.posexplode("sources").alias("source_idx", "source"))


def links(rows: DataFrame, clusters: DataFrame, field: str) -> DataFrame:
    """Distinct linked ids of a merged entity as rows."""
    return rows.join(clusters, ["project_id", "pos"]).select(
        "project_id", F.col("leader").alias("pos"), F.explode(field).alias("linked_id")).distinct()


def union_ids(a: Column, b: Column) -> Column:
    """Union of two id lists in sorted order."""
    return F.array_sort(F.array_union(a, b))


def overlay_maps(base: Column, own: Column) -> Column:
    """Own entries win over the base, also when their value is null."""
    keys = F.array_union(F.map_keys(base), F.map_keys(own))
    return F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.when(F.map_contains_key(own, k), F.try_element_at(own, k)).otherwise(F.try_element_at(base, k))))


def overlay_source(sources: Column, base: Column, fields: Sequence[str]) -> Column:
    """Fill fields of each source from the file's own source."""
    return F.transform(sources, lambda s: F.struct(*[F.coalesce(s[f], base[f]).alias(f) for f in fields]))


def register_files(known: DataFrame, new: DataFrame) -> DataFrame:
    """Add files whose name is not listed yet; the first of equal new names stays."""
    first = new.groupBy("project_id", "name").agg(
        F.min_by(F.struct(*[c for c in new.columns if c not in ("project_id", "name")]), "file_id").alias("f"))
    fresh = first.select("project_id", "name", "f.*").join(known, ["project_id", "name"], "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def append_passages(known: DataFrame, texts: DataFrame, passages: DataFrame) -> DataFrame:
    """Full text grows by one passage per text and by every entry of a list; blank ones are dropped."""
    single = texts.filter(F.trim("content") != "")
    many = passages.select(*[c for c in passages.columns if c != "contents"],
                           F.posexplode("contents").alias("entry", "content")).filter(F.trim("content") != "")
    return known.unionByName(single, allowMissingColumns=True).unionByName(many, allowMissingColumns=True)


CLUSTERS = {"spaces": space_clusters, "systems": system_clusters,
            "equipment": equipment_clusters, "milestones": milestone_clusters}
SURVIVING = {
    "spaces": ["name", "number", "area_m2", "volume_m3", "height_m", "usage", "storey", "zone", "guid", "system_ids", "equipment_ids", "sources"],
    "systems": ["kind", "name", "power_kw", "flow_m3h", "system_guid", "guid", "sources"],
    "equipment": ["kind", "name", "power_kw", "flow_m3h", "system_id", "space_id", "guid", "sources"],
}


def in_arrival_order(active: DataFrame | None, batch: DataFrame, file_order: str = "file_id") -> DataFrame:
    """Give batch rows dense positions after those of the active model, whatever their file ids.

    The offset is the largest position of the project, so it is one row per project.
    Rows of a batch come in the order of their file, then their own position.
    """
    spread = dense_ranks(batch, ["project_id", file_order, "pos"], ["project_id"], "_at", adaptive=True).withColumn("pos", F.col("_at")).drop("_at")
    if active is None:
        return spread
    top = active.groupBy("project_id").agg((F.max("pos") + 1).alias("_base"))
    return active.unionByName(
        spread.join(top, "project_id", "left")
        .withColumn("pos", F.col("pos") + F.coalesce("_base", F.lit(0))).drop("_base"), allowMissingColumns=True)


def merge_entities(kind: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Merged rows, their lineage and (spaces only) conflicts of one entity kind."""
    if kind not in CLUSTERS:
        return {"merged": rows, "lineage": rows.select(
            "project_id", "pos", F.col("pos").alias("member_pos"), F.posexplode("sources").alias("source_idx", "source"))}
    clusters = CLUSTERS[kind](rows)
    out = {"lineage": lineage(rows, clusters), "clusters": clusters}
    if kind == "milestones":
        leads = clusters.filter("pos = leader").select("project_id", "pos")
        out["merged"] = rows.join(leads, ["project_id", "pos"], "left_semi")
    else:
        out["merged"] = survivors(rows, clusters, SURVIVING[kind])
    if kind == "spaces":
        out["conflicts"] = conflicts(rows, clusters, ["area_m2", "volume_m3", "height_m"])
    if kind == "systems":
        out["space_links"] = links(rows, clusters, "space_ids")
        out["equipment_links"] = links(rows, clusters, "equipment_ids")
    return out


def merge_all(entities: Mapping[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """The whole merge of a batch of files: merge_entities of every kind. Kinds without matching rules pass through."""
    return {kind: merge_entities(kind, rows) for kind, rows in entities.items()}
