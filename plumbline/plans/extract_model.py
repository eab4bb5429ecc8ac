"""Entities from building models: object and relation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import contains_any, has_number, or_null

FILE = ["file_id"]


def in_set(psets: Column, set_name: str, key: str) -> Column:
    return F.try_element_at(F.try_element_at(psets, F.lit(set_name)), F.lit(key))


def in_any_set(psets: Column, key: str) -> Column:
    """Value of the first property set that has the key."""
    holder = F.try_element_at(F.filter(F.map_values(psets), lambda m: F.map_contains_key(m, F.lit(key))), F.lit(1))
    return F.try_element_at(holder, F.lit(key))


def number_of(*values: Column) -> Column:
    """The first value that is a number other than zero."""
    tried = [v.try_cast("double") for v in values]
    return F.coalesce(*[F.when(has_number(t), t) for t in tried])


def _group_of(objects: DataFrame, relations: DataFrame, rel_class: str, group_class: str, name: str) -> DataFrame:
    """Per related object the name of its first group of a class, in relation order."""
    groups = objects.filter(F.col("class") == group_class).select(
        *FILE, F.col("guid").alias("relating_guid"), F.coalesce(or_null("name"), "guid").alias("_label"))
    return (
        relations.filter(F.col("rel_class") == rel_class).join(groups, [*FILE, "relating_guid"])
        .groupBy(*FILE, F.col("related_guid").alias("guid"))
        .agg(F.min_by("_label", "rel_order").alias(name))
    )


def zone_of_space(objects: DataFrame, relations: DataFrame) -> DataFrame:
    return _group_of(objects, relations, "IfcRelAssignsToGroup", "IfcZone", "zone")


def storey_of_space(objects: DataFrame, relations: DataFrame) -> DataFrame:
    return _group_of(objects, relations, "IfcRelContainedInSpatialStructure", "IfcBuildingStorey", "storey")


def spaces_from_model(objects: DataFrame, relations: DataFrame) -> DataFrame:
    p = F.col("psets")
    base = objects.filter(F.col("class") == "IfcSpace").select(
        *FILE, F.concat(F.lit("Raum_"), "guid").alias("id"), "guid",
        F.coalesce(or_null("long_name"), or_null("name"), F.lit("")).alias("name"),
        F.coalesce("name", F.lit("")).alias("number"),
        in_set(p, "Pset_SpaceCommon", "Usage").alias("usage"),
        in_set(p, "Pset_SpaceCommon", "Level").alias("_level"),
        number_of(in_any_set(p, "NetFloorArea"), in_any_set(p, "GrossFloorArea")).alias("area_m2"),
        number_of(in_any_set(p, "NetVolume"), in_any_set(p, "GrossVolume")).alias("volume_m3"),
        number_of(in_any_set(p, "Height")).alias("height_m"))
    return (
        base.join(zone_of_space(objects, relations), [*FILE, "guid"], "left")
        .join(storey_of_space(objects, relations), [*FILE, "guid"], "left")
        .withColumn("storey", F.coalesce("storey", "_level")).drop("_level")
    )


def systems_from_model(objects: DataFrame) -> DataFrame:
    p = F.col("psets")
    return objects.filter((F.col("class") == "IfcSystem") & contains_any("system_type", V.SYSTEM_TYPE_WORDS)).select(
        *FILE, F.concat(F.lit("ANL_"), "guid").alias("id"), "guid", F.col("guid").alias("system_guid"),
        F.coalesce(or_null("system_type"), or_null("name"), F.lit("HLKS-System")).alias("kind"),
        F.coalesce("name", F.lit("")).alias("name"),
        number_of(in_any_set(p, "TotalPower"), in_any_set(p, "Power")).alias("power_kw"),
        number_of(in_any_set(p, "AirFlowRate"), in_any_set(p, "FlowRate")).alias("flow_m3h"))


def equipment_from_model(objects: DataFrame) -> DataFrame:
    """Old schemas list their own classes, new ones a single class; without a schema the old
    classes are tried first. Terminals always count. An object counts once."""
    old = F.col("class").isin(V.OLD_SCHEMA_EQUIPMENT)
    new = F.col("class") == V.NEW_SCHEMA_EQUIPMENT
    known_old = F.col("schema").startswith("IFC2X3")
    unknown = F.coalesce(F.col("schema"), F.lit("")) == ""
    files_with_old = objects.filter(unknown & old).select(*FILE).distinct().withColumn("_has_old", F.lit(True))
    wanted = objects.filter(old | new | (F.col("class") == V.TERMINAL_CLASS)).join(files_with_old, FILE, "left")
    machine = (
        F.when(unknown, F.when(F.coalesce("_has_old", F.lit(False)), old).otherwise(new))
        .when(known_old, old).otherwise(new)
    )
    p = F.col("psets")
    terminal = F.col("class") == V.TERMINAL_CLASS
    rows = wanted.filter(machine | terminal).select(
        *FILE, F.concat(F.lit("GER_"), "guid").alias("id"), "guid",
        F.coalesce(or_null("object_type"), or_null("name"),
                   F.when(terminal, "Flow Terminal").otherwise("Mechanisches Gerät")).alias("kind"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.when(~terminal, number_of(in_set(p, "Pset_MechanicalEquipment", "Power"),
                                    in_set(p, "Pset_MechanicalEquipment", "TotalPower"))).alias("power_kw"),
        F.when(terminal, number_of(in_set(p, "Pset_FlowTerminal", "FlowRate"),
                                   in_set(p, "Pset_FlowTerminal", "AirFlowRate"))).alias("flow_m3h"),
        F.col("class").alias("object"))
    return rows.dropDuplicates([*FILE, "guid"])


def served_spaces(relations: DataFrame, systems: DataFrame, spaces: DataFrame) -> DataFrame:
    """Distinct (system, space) pairs of the service relations; read it from either side.

    The systems of all models are sent to all tasks. Relations that are dealt by file_id and related_guid are not shuffled:
    what a space is served by is collapsed where they lie, and only spaces that share their id with others meet again.
    """
    s = systems.groupBy(*FILE, F.col("guid").alias("relating_guid")).agg(F.min("id").alias("system_id"))
    r = spaces.groupBy(*FILE, F.col("guid").alias("related_guid")).agg(F.min("id").alias("space_id"))
    shared = r.groupBy(F.col("file_id").alias("_file"), F.col("space_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same_id = (F.col("file_id") == F.col("_file")) & F.col("space_id").eqNullSafe(F.col("_id"))
    serves = (
        relations.filter(F.col("rel_class") == "IfcRelServicesBuildings")
        .join(F.broadcast(s), [*FILE, "relating_guid"])
        .groupBy(*FILE, "related_guid", "system_id").agg(F.min("rel_order").alias("rel_order"))
    )

    def of(some: DataFrame) -> DataFrame:
        return serves.join(some.hint("shuffle_hash"), [*FILE, "related_guid"]).select(*FILE, "system_id", "space_id", "rel_order")

    again = of(r.join(shared, same_id, "left_semi")).groupBy(*FILE, "system_id", "space_id").agg(F.min("rel_order").alias("rel_order"))
    return of(r.join(shared, same_id, "left_anti")).unionByName(again)
