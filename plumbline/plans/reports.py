"""Questions, risks, timeline, staffing, scope and list reports as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import has_number, has_text, or_null

BUCKETS = ["fehler", "warnungen", "hinweise"]
BUCKET_PRIORITY = {"fehler": "kritisch", "warnungen": "wichtig", "hinweise": "information"}


def questions(routed: DataFrame) -> DataFrame:
    """One question per routed issue; `bucket_order` and `pos` give the order within a project."""
    b = F.col("bucket")
    order, prio = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(BUCKETS))):
        order = F.when(b == name, i).otherwise(order)
        prio = F.when(b == name, BUCKET_PRIORITY[name]).otherwise(prio)
    return routed.select("project_id", order.alias("bucket_order"), "pos", "category", F.col("text").alias("question"),
                         prio.alias("priority"), "source_files", "advice", "entity_id")


def project_size(spaces: DataFrame, systems: DataFrame, equipment: DataFrame) -> DataFrame:
    """Counts per project in one aggregation; spaces without an area are counted too."""
    none = F.lit(None).cast("double")
    rows = (
        spaces.select("project_id", F.lit("spaces").alias("kind"), F.col("area_m2").alias("area"))
        .unionByName(systems.select("project_id", F.lit("systems").alias("kind"), none.alias("area")))
        .unionByName(equipment.select("project_id", F.lit("equipment").alias("kind"), none.alias("area")))
    )
    k = F.col("kind")
    return rows.groupBy("project_id").agg(
        F.count_if(k == "spaces").alias("spaces"), F.count_if(k == "systems").alias("systems"),
        F.count_if(k == "equipment").alias("equipment"),
        F.count_if((k == "spaces") & ~has_number("area")).alias("spaces_without_area"))


def risk_level(likelihood: Column, impact: Column) -> Column:
    pairs = [F.lit(x) for (l, i), level in V.RISK_LEVELS.items() for x in (f"{l}|{i}", level)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("|", likelihood, impact)), F.lit("UNBEKANNT"))


def threshold_risks(size: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Risks of each project whose test holds, with level and teaser; `risk_no` gives their order."""
    def risk(test: Column, no: int, category: str, text: Column, likelihood: str, impact: str, action: str) -> Column:
        return F.when(test, F.struct(
            F.lit(no).alias("risk_no"), F.lit(category).alias("category"), text.alias("text"),
            F.lit(likelihood).alias("likelihood"), F.lit(impact).alias("impact"), F.lit(action).alias("action")))

    joined = size.join(verdicts.select("project_id", "fehler"), "project_id", "left")
    n, s, gap, bad = F.col("spaces"), F.col("systems"), F.col("spaces_without_area"), F.coalesce("fehler", F.lit(0))
    fired = F.filter(F.array(
        risk(gap > 0, 1, "Datenqualität", F.concat(gap.cast("string"), F.lit(" Räume ohne Flächenangabe")),
             "hoch", "mittel", "Fehlende Flächenangaben ergänzen"),
        risk(n > 100, 2, "Projektkomplexität", F.concat(F.lit("Hohe Anzahl von Räumen ("), n.cast("string"), F.lit(")")),
             "mittel", "hoch", "Projekt in Phasen aufteilen, zusätzliche Ressourcen einplanen"),
        risk(s > 20, 3, "Projektkomplexität", F.concat(F.lit("Hohe Anzahl von Anlagen ("), s.cast("string"), F.lit(")")),
             "mittel", "hoch", "Anlagen-Koordination intensivieren"),
        risk(bad > 0, 4, "Datenqualität", F.concat(bad.cast("string"), F.lit(" kritische Validierungsfehler gefunden")),
             "hoch", "hoch", "Validierungsfehler beheben bevor mit Offerte fortgefahren wird"),
    ), lambda x: x.isNotNull())
    rows = joined.select("project_id", F.inline(fired))
    return rows.withColumn("level", risk_level(F.col("likelihood"), F.col("impact"))).withColumn("teaser", X.teaser("text"))


def actions(risks: DataFrame) -> DataFrame:
    return risks.filter(has_text("action")).select("project_id", "category", "action")


def phases(start: str) -> Column:
    """array<struct<no, phase, default_text, days, starts, ends>>; each phase starts where the last one ends."""
    out, day = [], 0
    for no, (phase, days) in enumerate(zip(V.PHASES, V.PHASE_DAYS), 1):
        out.append(F.struct(
            F.lit(no).alias("phase_no"), F.lit(phase).alias("phase"), F.lit(V.PHASE_DEFAULT_TEXT[phase]).alias("default_text"),
            F.lit(days).alias("days"), F.date_add(F.lit(start).cast("date"), day).alias("starts"),
            F.date_add(F.lit(start).cast("date"), day + days).alias("ends")))
        day += days
    return F.array(*out)


def _in_phases(items: DataFrame, kind: str, start: str, extra: Column) -> DataFrame:
    """Items under every phase whose label their phase text holds."""
    hit = F.filter(phases(start), lambda p: F.contains(F.coalesce("phase", F.lit("")), p["phase"]))
    return items.select("project_id", F.lit(kind).alias("item_kind"), "pos", "text", extra.alias("due"),
                        F.inline(hit)).drop("default_text")


def timeline(projects: DataFrame, services: DataFrame, milestones: DataFrame, start: str) -> DataFrame:
    """Rows per project and phase: the phase itself, its services and its milestones."""
    frame = projects.select(F.col("id").alias("project_id"), F.lit("phase").alias("item_kind"), F.lit(0).cast("long").alias("pos"),
                            F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("due"),
                            F.inline(phases(start))).drop("default_text")
    return (
        frame.unionByName(_in_phases(services, "service", start, F.lit(None).cast("string")))
        .unionByName(_in_phases(milestones, "milestone", start, F.coalesce("due", F.lit("-"))))
    )


def running_phase_days(phase_rows: DataFrame, keys: list[str], order: str, days: str, start: Column) -> DataFrame:
    """Start and end of phases from their durations."""
    from plumbline.operators.ordered import running_sum

    total = running_sum(phase_rows, keys, order, F.col(days), "_until")
    return total.withColumns({
        "starts": F.date_add(start, (F.col("_until") - F.col(days)).cast("int")),
        "ends": F.date_add(start, F.col("_until").cast("int"))}).drop("_until")


def staffing(size: DataFrame) -> DataFrame:
    team = X.team_size(F.col("spaces"), F.col("systems"))
    return size.select("project_id", "spaces", "systems", "equipment", team.alias("team"), F.lit(1).cast("long").alias("leads"),
                       X.engineers(team).alias("engineers"), X.drafters(team).alias("drafters"))


def responsibilities(projects: DataFrame) -> DataFrame:
    """The fixed responsibility rows for every project."""
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("task"), F.lit(l).alias("level"))
                     for r, t, l in V.RESPONSIBILITIES])
    return projects.select(F.col("id").alias("project_id"), F.inline(rows))


def scope(projects: DataFrame, services: DataFrame, size: DataFrame, start: str = "2000-01-01") -> DataFrame:
    """Per project and phase: default text, number of matching services, project counts."""
    frame = projects.select(F.col("id").alias("project_id"), "name", F.coalesce(or_null("location"), F.lit("-")).alias("location"),
                            F.inline(phases(start))).drop("starts", "ends", "days")
    counts = _in_phases(services, "service", start, F.lit(None).cast("string")).groupBy("project_id", "phase_no").agg(
        F.count(F.lit(1)).alias("services"))
    return (
        frame.join(counts, ["project_id", "phase_no"], "left").join(size, "project_id", "left")
        .select("project_id", "name", "location", "phase_no", "phase", "default_text",
                *[F.coalesce(c, F.lit(0)).alias(c) for c in ("services", "spaces", "systems", "equipment")])
    )


def scope_services(services: DataFrame) -> DataFrame:
    return _in_phases(services, "service", "2000-01-01", F.lit(None).cast("string")).select(
        "project_id", "phase_no", "phase", "pos", "text")


def ready_for_offer(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("status") == "offertreif")


def question_list(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Questions under their category. `category_pos` orders categories by first appearance.

    The grouping is an order over rows, so a category may hold any number of them.
    """
    cat = rows.withColumn("category", F.coalesce("category", F.lit("Sonstiges")))
    first = cat.groupBy(*keys, "category").agg(F.min("pos").alias("category_pos"))
    return cat.join(first, [*keys, "category"])


def finding_list(findings: DataFrame) -> DataFrame:
    """Findings with their heading and the citation after the quote."""
    cite = X.citation(F.col("source_file"), F.col("source_para"))
    return findings.withColumns({
        "heading": F.concat(F.lit("["), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit("] "), F.col("title")),
        "citation": F.when(has_text("quote") & (cite != ""), F.concat(F.lit(" (Quelle: "), cite, F.lit(")"))).otherwise(""),
        "rating_label": F.upper("rating")})


def report_rows(projects: DataFrame, kinds: list[str], at: Column, versions: DataFrame) -> DataFrame:
    """Metadata of the generated reports: one row per project and kind with its next version."""
    made = projects.select(F.col("id").alias("project_id"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("report"))
    last = versions.groupBy("project_id", "report").agg(F.max("version").alias("_v"))
    return made.join(last, ["project_id", "report"], "left").select(
        "project_id", "report", (F.coalesce("_v", F.lit(0)) + 1).alias("version"),
        F.concat_ws("_", F.col("report"), F.col("project_id").cast("string"), F.date_format(at, "yyyyMMdd_HHmmss")).alias("file_name"),
        at.alias("created_at"))


def batch_result(rows: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Per batch: number of results, failures, and whether any came out."""
    return rows.groupBy(*keys).agg(
        F.count_if(ok).alias("generated"), F.count_if(~ok).alias("failed")).withColumn("success", F.col("generated") > 0)
