"""Row types of the project model, as DDL. Every entity also has project_id and pos (arrival order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SOURCE_FIELDS = {
    "file": "string", "file_id": "bigint", "uploaded_at": "timestamp", "sheet": "string", "row": "int",
    "para": "int", "section": "string", "table": "int", "page": "int", "cell": "string", "guid": "string",
    "object": "string", "kind": "string", "position": "int",
}
SOURCE = "struct<" + ", ".join(f"`{k}`: {v}" for k, v in _SOURCE_FIELDS.items()) + ">"


def source(**known):
    """A source struct; fields that are not given are null."""
    return F.struct(*[
        known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _SOURCE_FIELDS.items()])


def _entity(ddl: str) -> str:
    return f"project_id bigint, pos bigint, {ddl}, sources array<{SOURCE}>"


SPACE = _entity(
    "id string, name string, number string, area_m2 double, volume_m3 double, height_m double, usage string, "
    "storey string, zone string, guid string, system_ids array<string>, equipment_ids array<string>")
SYSTEM = _entity(
    "id string, kind string, name string, power_kw double, flow_m3h double, space_ids array<string>, "
    "equipment_ids array<string>, system_guid string, guid string")
EQUIPMENT = _entity(
    "id string, kind string, name string, power_kw double, flow_m3h double, system_id string, space_id string, guid string")
REQUIREMENT = _entity(
    "id string, text string, category string, priority string, phase string, space_ids array<string>, system_ids array<string>")
MILESTONE = _entity("id string, text string, due string, category string, service_id string, phase string")
SERVICE = _entity(
    "id string, text string, phase string, category string, unit string, quantity double, "
    "space_ids array<string>, system_ids array<string>")
RISK = _entity("id string, text string, category string, likelihood string, impact string, action string")
ISSUE = (
    "project_id bigint, rule_id string, family string, category string, severity string, text string, "
    "source_files array<string>, advice string, entity_id string, pos bigint")
PROJECT = "id bigint, name string, description string, location string, status string, created_at timestamp"
FILE = (
    "file_id bigint, project_id bigint, name string, path string, size bigint, mime string, "
    "uploaded_at timestamp, processed boolean, error string")
SNAPSHOT = "project_id bigint, version int, is_active boolean, created_at timestamp"
CELL = "file_id bigint, sheet string, row int, col int, value string, dtype string"
PARAGRAPH = "file_id bigint, para_idx int, style string, text string"
TABLE_CELL = "file_id bigint, table_idx int, row int, col int, text string"
PAGE = "file_id bigint, page int, text string"
TOKEN = "file_id bigint, page int, text string, left int, top int, width int"
MODEL_OBJECT = (
    "file_id bigint, schema string, guid string, class string, name string, long_name string, object_type string, "
    "system_type string, psets map<string, map<string, string>>")
MODEL_RELATION = "file_id bigint, rel_order int, rel_class string, relating_guid string, related_guid string"
EVENT_LOG = (
    "fileId bigint, filename string, timestamp string, saved_at string, "
    "logs array<struct<timestamp: string, message: string, data: string>>, "
    "summary struct<totalLogs: bigint, errors: bigint, warnings: bigint>")
ENTITIES = {
    "spaces": SPACE, "systems": SYSTEM, "equipment": EQUIPMENT, "requirements": REQUIREMENT,
    "milestones": MILESTONE, "services": SERVICE,
}


def empty_model(projects: DataFrame) -> DataFrame:
    """First version of each project: id text, version 1, no entities yet."""
    return projects.select(
        F.format_string("PROJ_%06d", "id").alias("id"), "name", "description", "location",
        F.lit(1).alias("version"),
        *[F.array().cast(f"array<struct<{schema}>>").alias(name) for name, schema in ENTITIES.items()])
