"""Data-quality rules. Each rule is a set of issue rows; rules over one entity share its scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import has_number, has_text
from plumbline.operators.ordered import compared_with_first

CONSISTENCY, REFERENCES, PLAUSIBILITY, SPEC = "consistency", "references", "plausibility", "spec"


def source_files(sources: Column) -> Column:
    """Distinct source files in first-seen order."""
    return F.array_distinct(F.transform(sources, lambda s: F.coalesce(s["file"], F.lit("unbekannt"))))


def _txt(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])


def issue(rule: str, family: str, category: str, severity: str, text: Column, advice: Column,
          files: Column, entity: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(family).alias("family"), F.lit(category).alias("category"),
        F.lit(severity).alias("severity"), text.alias("text"), files.alias("source_files"),
        advice.alias("advice"), entity.cast("string").alias("entity_id"))


def _fired(df: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One scan for many rules: (test, issue) pairs; only issues whose test holds come out."""
    made = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), body) for test, body in rules]), lambda x: x.isNotNull())
    return df.select("project_id", "pos", F.inline(made))


def _files() -> Column:
    return source_files(F.col("sources"))


# --- consistency ---------------------------------------------------------------------

def contradictions(rows: DataFrame, keys: Sequence[str], field: str, tolerance: float, rule: str,
                   label: Column, unit: str, noun: str, what: str) -> DataFrame:
    """Later rows of a key whose value differs from that of the first row of the key."""
    pairs = compared_with_first(rows, ["project_id", *keys], "pos", [field, "sources"])
    old, new = F.col(f"first.{field}"), F.col(field)
    both = F.array_distinct(F.concat(source_files(F.col("first.sources")), _files()))
    return _fired(pairs, [(
        has_number(old) & has_number(new) & (F.abs(old - new) > tolerance),
        issue(rule, CONSISTENCY, "Widerspruch", "kritisch",
              _txt(noun, label, f" hat unterschiedliche {what}: ", old, f" {unit} vs ", new, f" {unit}"),
              _txt(f"Bitte {what} für ", label, " prüfen und vereinheitlichen"), both, F.col("id")))])


def space_area_by_id(spaces: DataFrame) -> DataFrame:
    return contradictions(spaces, ["id"], "area_m2", 0.1, "V01", F.col("id"), "m²", "Raum ", "Flächenangaben")


def space_area_by_number(spaces: DataFrame) -> DataFrame:
    rows = spaces.withColumn("number", F.lower("number")).filter(has_text("number"))
    return contradictions(rows, ["number"], "area_m2", 0.1, "V02", F.col("number"), "m²", "Raum mit Nummer ", "Flächenangaben")


Rule = tuple[Column, Column]


def volume_rule() -> list[Rule]:
    a, h, v = F.col("area_m2"), F.col("height_m"), F.col("volume_m3")
    return [(
        has_number(a) & has_number(h) & has_number(v) & (F.abs(v - a * h) > 0.5),
        issue("V03", CONSISTENCY, "Plausibilitätsfehler", "warnung",
              _txt("Raum ", F.col("id"), ": Volumen (", v, " m³) ist nicht Fläche × Höhe (", a * h, " m³)"),
              _txt("Bitte Volumen oder Höhe für Raum ", F.col("id"), " prüfen"), _files(), F.col("id")))]


def space_volume(spaces: DataFrame) -> DataFrame:
    return _fired(spaces, volume_rule())


def system_power(systems: DataFrame) -> DataFrame:
    return contradictions(systems, ["id"], "power_kw", 0.1, "V04", F.col("id"), "kW", "Anlage ", "Leistungsangaben")


# --- references -----------------------------------------------------------------------

def _ids(rows: DataFrame, flag: str, key: str) -> DataFrame:
    return rows.select("project_id", F.col("id").alias(key)).distinct().withColumn(flag, F.lit(True))


def equipment_references(equipment: DataFrame, systems: DataFrame, spaces: DataFrame, more: Sequence[Rule] = ()) -> DataFrame:
    """V05-V07: at most one issue per piece of equipment, in this order of precedence.

    `more` rules on the same rows share the scan.
    """
    joined = (
        equipment.join(_ids(systems, "_system", "system_id"), ["project_id", "system_id"], "left")
        .join(_ids(spaces, "_space", "space_id"), ["project_id", "space_id"], "left")
    )
    e, s, r = F.col("id"), F.col("system_id"), F.col("space_id")
    loose = ~has_text(s) & ~has_text(r)
    no_system = has_text(s) & F.col("_system").isNull()
    no_space = has_text(r) & F.col("_space").isNull()
    return _fired(joined, [
        (loose, issue("V05", REFERENCES, "Fehlende Angabe", "warnung",
                      _txt("Gerät ", e, " ist keinem Raum oder keiner Anlage zugeordnet"),
                      _txt("Bitte Zuordnung für Gerät ", e, " ergänzen"), _files(), e)),
        (no_system, issue("V06", REFERENCES, "Referenzfehler", "kritisch",
                          _txt("Gerät ", e, " referenziert nicht existierende Anlage ", s),
                          _txt("Bitte Anlage ", s, " prüfen oder Gerät korrigieren"), _files(), e)),
        (no_space & ~no_system, issue("V07", REFERENCES, "Referenzfehler", "kritisch",
                                      _txt("Gerät ", e, " referenziert nicht existierenden Raum ", r),
                                      _txt("Bitte Raum ", r, " prüfen oder Gerät korrigieren"), _files(), e)),
        *more,
    ])


#: Fixed wording of a missing target.
MISSING = {"Raum ": "existierenden", "Gerät ": "existierendes", "Anlage ": "existierende"}


def dangling(rows: DataFrame, field: str, targets: DataFrame, rule: str, noun: str, target_noun: str) -> DataFrame:
    """List references without a target, one issue per element; no id equals no id."""
    refs = rows.select("project_id", "pos", "id", "sources", F.explode(field).alias("_ref"))
    known = targets.select("project_id", F.col("id").alias("_ref"))
    lost = refs.alias("l").join(known.alias("r"), (
        F.col("l.project_id").eqNullSafe(F.col("r.project_id"))) & F.col("l._ref").eqNullSafe(F.col("r._ref")), "left_anti")
    return _fired(lost, [(F.lit(True), issue(
        rule, REFERENCES, "Referenzfehler", "kritisch",
        _txt(noun, F.col("id"), f" referenziert nicht {MISSING[target_noun]} {target_noun}", F.col("_ref")),
        _txt("Bitte ", target_noun, F.col("_ref"), " prüfen oder ", noun, "korrigieren"), _files(), F.col("id")))])


def milestone_services(milestones: DataFrame, services: DataFrame) -> DataFrame:
    lost = milestones.filter(has_text("service_id")).join(
        services.select("project_id", F.col("id").alias("service_id")), ["project_id", "service_id"], "left_anti")
    return _fired(lost, [(F.lit(True), issue(
        "V12", REFERENCES, "Referenzfehler", "warnung",
        _txt("Termin ", F.col("id"), " referenziert nicht existierende Leistung ", F.col("service_id")),
        _txt("Bitte Leistung ", F.col("service_id"), " prüfen oder Termin korrigieren"), _files(), F.col("id")))])


# --- plausibility --------------------------------------------------------------------------

def _range_issue(rule: str, severity: str, noun: str, what: str, value: Column) -> Column:
    return issue(rule, PLAUSIBILITY, "Plausibilitätsfehler", severity,
                 _txt(noun, F.col("id"), f": {what} ", value), _txt(f"Bitte {noun}", F.col("id"), " prüfen"), _files(), F.col("id"))


def space_ranges(spaces: DataFrame) -> DataFrame:
    return _fired(spaces, space_range_rules())


def space_range_rules() -> list[Rule]:
    """V13-V17 in one scan."""
    a, v, h = F.col("area_m2"), F.col("volume_m3"), F.col("height_m")
    return [
        (a <= 0, _range_issue("V13", "kritisch", "Raum ", "ungültige Fläche", a)),
        (a > 10000, _range_issue("V14", "hinweis", "Raum ", "sehr große Fläche", a)),
        (v <= 0, _range_issue("V15", "kritisch", "Raum ", "ungültiges Volumen", v)),
        (h <= 0, _range_issue("V16", "kritisch", "Raum ", "ungültige Höhe", h)),
        (h > 10, _range_issue("V17", "hinweis", "Raum ", "sehr hohe Raumhöhe", h)),
    ]


def system_ranges(systems: DataFrame) -> DataFrame:
    return _fired(systems, system_range_rules())


def system_range_rules() -> list[Rule]:
    """V18-V20 in one scan."""
    p, f = F.col("power_kw"), F.col("flow_m3h")
    return [
        (p < 0, _range_issue("V18", "kritisch", "Anlage ", "negative Leistung", p)),
        (p > 10000, _range_issue("V19", "hinweis", "Anlage ", "sehr große Leistung", p)),
        (f < 0, _range_issue("V20", "kritisch", "Anlage ", "negativer Volumenstrom", f)),
    ]


def equipment_ranges(equipment: DataFrame) -> DataFrame:
    return _fired(equipment, equipment_range_rules())


def equipment_range_rules() -> list[Rule]:
    p = F.col("power_kw")
    return [(p < 0, _range_issue("V21", "kritisch", "Gerät ", "negative Leistung", p))]


def spec_ranges(rows: DataFrame, limits: Mapping[str, tuple[float | None, float | None]], noun: str) -> DataFrame:
    """V28: limits of the specification, field -> (least, most)."""
    rules = []
    for field, (least, most) in limits.items():
        c = F.col(field)
        if least is not None:
            rules.append((c < least, _range_issue("V28", "hinweis", noun, f"{field} unter {least}:", c)))
        if most is not None:
            rules.append((c > most, _range_issue("V28", "hinweis", noun, f"{field} über {most}:", c)))
    return _fired(rows, rules)


# --- specification ------------------------------------------------------------------------------

FIELD_OF = {"name": "name", "standort": "location", "id": "id", "flaeche_m2": "area_m2", "typ": "kind"}


def project_fields(projects: DataFrame, fields: Sequence[str]) -> DataFrame:
    """V22: required project fields that are missing or empty."""
    rows = projects.select(F.col("id").alias("project_id"), F.lit(0).cast("long").alias("pos"), "*")
    none = F.array().cast("array<string>")
    return _fired(rows, [(
        ~has_text(F.col(FIELD_OF.get(f, f)).cast("string")),
        issue("V22", SPEC, "Fehlende Angabe", "kritisch", _txt(f"Projekt-Parameter '{f}' fehlt"),
              _txt(f"Bitte '{f}' für das Projekt ergänzen"), none, F.lit(None))) for f in fields])


def too_few(projects: DataFrame, rows: DataFrame, least: int, noun: str = "Raum/Räume") -> DataFrame:
    """V23: projects with fewer rows than the specification asks for."""
    counts = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    joined = projects.select(F.col("id").alias("project_id"), F.lit(0).cast("long").alias("pos")).join(
        counts, "project_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _fired(joined, [(
        F.col("n") < least,
        issue("V23", SPEC, "Fehlende Angabe", "kritisch",
              _txt(f"Mindestens {least} {noun} erforderlich, vorhanden: ", F.col("n")),
              _txt(f"Bitte mindestens {least} {noun} hinzufügen"), F.array().cast("array<string>"), F.lit(None)))])


def required_fields(rows: DataFrame, fields: Sequence[str], rule: str, severity: str, noun: str) -> DataFrame:
    """V24, V25: required fields that are null; empty text passes."""
    return _fired(rows, required_field_rules(fields, rule, severity, noun))


def required_field_rules(fields: Sequence[str], rule: str, severity: str, noun: str) -> list[Rule]:
    return [(
        F.col(FIELD_OF.get(f, f)).isNull(),
        issue(rule, SPEC, "Fehlende Angabe", severity, _txt(noun, F.col("id"), f" hat kein Feld '{f}'"),
              _txt(f"Bitte '{f}' für {noun}", F.col("id"), " ergänzen"), _files(), F.col("id"))) for f in fields]


def missing_services(services: DataFrame, spec: Mapping = V.OFFER_SPEC, projects: DataFrame | None = None) -> DataFrame:
    """J16: services a phase demands that no item of the project provides in that phase.

    `projects` (id) names the projects to look at: one without any service lacks all of them. Without it only
    projects with services are known.
    """
    demands = F.array(*[
        F.struct(F.lit(p["phase"]).alias("phase"), F.lit(d).alias("demand"))
        for p in spec["sia_phasen"] for d in p["erforderliche_leistungen"]])
    met = services.select("project_id", F.explode(F.filter(demands, lambda d: F.contains(
        F.coalesce(F.col("phase"), F.lit("")), d["phase"]) & F.contains(F.col("text"), d["demand"]))).alias("d")).distinct()
    known = services.select("project_id") if projects is None else projects.select(F.col("id").alias("project_id"))
    wanted = known.distinct().select("project_id", F.explode(demands).alias("d"))
    return wanted.join(met, ["project_id", "d"], "left_anti").select("project_id", "d.phase", "d.demand")


# --- all rules -------------------------------------------------------------------------------------

def all_issues(model: Mapping[str, DataFrame], spec: Mapping = V.OFFER_SPEC) -> DataFrame:
    need = spec["mindestanforderungen"]
    spaces, systems, equipment = model["spaces"], model["systems"], model["equipment"]
    # rules that look at one row share one scan of their entity
    space_rules = [*volume_rule(), *space_range_rules(),
                   *required_field_rules(need["raeume"]["erforderliche_felder"], "V24", "kritisch", "Raum ")]
    system_rules = [*system_range_rules(),
                    *required_field_rules(need["anlagen"]["erforderliche_felder"], "V25", "warnung", "Anlage ")]
    parts = [
        space_area_by_id(spaces), space_area_by_number(spaces), system_power(systems),
        _fired(spaces, space_rules), _fired(systems, system_rules),
        equipment_references(equipment, systems, spaces, more=equipment_range_rules()),
        dangling(systems, "space_ids", spaces, "V08", "Anlage ", "Raum "),
        dangling(systems, "equipment_ids", equipment, "V09", "Anlage ", "Gerät "),
        dangling(spaces, "system_ids", systems, "V10", "Raum ", "Anlage "),
        dangling(spaces, "equipment_ids", equipment, "V11", "Raum ", "Gerät "),
        milestone_services(model["milestones"], model["services"]),
        project_fields(model["projects"], need["projekt"]["erforderliche_felder"]),
        too_few(model["projects"], spaces, need["raeume"]["min_anzahl"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def route(issues: DataFrame, routing: str = "reference") -> DataFrame:
    """Bucket of each issue. By default critical plausibility issues and hints of the other families fall out."""
    bucket = (F.when(F.col("severity") == "kritisch", "fehler").when(F.col("severity") == "warnung", "warnungen")
              .when(F.col("severity") == "hinweis", "hinweise"))
    out = issues.withColumn("bucket", bucket)
    if routing == "all":
        return out
    plausible = F.col("family") == PLAUSIBILITY
    taken = (plausible & F.col("severity").isin("warnung", "hinweis")) | (
        ~plausible & F.col("severity").isin("kritisch", "warnung"))
    return out.filter(taken)


def verdicts(projects: DataFrame, routed: DataFrame) -> DataFrame:
    """Per project: bucket sizes, consistency and the status to write back."""
    sizes = routed.groupBy("project_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("fehler", "warnungen", "hinweise")])
    joined = projects.select(F.col("id").alias("project_id")).join(sizes, "project_id", "left")
    filled = joined.select("project_id", *[F.coalesce(b, F.lit(0)).alias(b) for b in ("fehler", "warnungen", "hinweise")])
    return filled.withColumn("consistent", F.col("fehler") == 0).withColumn(
        "status", F.when(F.col("fehler") == 0, "validated").otherwise("validation_errors"))
