"""Entities from paragraphs, pages and plan text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import contains_any, long_enough, or_null
from plumbline.operators.ordered import fill_down


def is_heading(style: Column) -> Column:
    return contains_any(style, ["heading", "überschrift"])


def heading_level(style: Column) -> Column:
    low = F.lower(style)
    return (F.when(contains_any(low, ["heading 2", "überschrift 2"]), 2)
            .when(contains_any(low, ["heading 3", "überschrift 3"]), 3).otherwise(1))


def _filled(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("text", X.strip("text")).filter(F.col("text") != "")


def sections(paragraphs: DataFrame) -> DataFrame:
    """Outline rows: one per heading with its level."""
    rows = _filled(paragraphs).filter(is_heading(F.col("style")))
    return rows.select("file_id", F.lower("text").alias("section"), heading_level(F.col("style")).alias("level"), "para_idx")


def with_section(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph with the last heading at or before it."""
    heading = F.when(is_heading(F.col("style")), F.lower("text"))
    return fill_down(_filled(paragraphs), ["file_id"], "para_idx", heading, "section")


def requirements_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    return with_section(paragraphs).filter(contains_any("text", V.REQUIREMENT_WORDS)).select(
        "file_id", F.format_string("REQ_%04d", "para_idx").alias("id"), "text",
        X.requirement_category("text").alias("category"),
        X.requirement_priority("text").alias("priority"),
        X.phase_of("text").alias("phase"),
        "para_idx", "section")


def requirements_from_lists(paragraphs: DataFrame) -> DataFrame:
    """List items by their own word list; they come on top of the paragraph rows."""
    rows = _filled(paragraphs).filter(F.col("style").startswith("List") | F.col("style").startswith("Aufzählung"))
    return rows.filter(contains_any("text", V.LIST_REQUIREMENT_WORDS)).select(
        "file_id", F.format_string("REQ_LIST_%04d", "para_idx").alias("id"), "text",
        F.lit("allgemein").alias("category"), F.lit("mittel").alias("priority"), "para_idx",
        F.lit("liste").alias("source_kind"))


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with text, each under its page line, in parts of bounded size (see joined_text)."""
    from plumbline.operators.ordered import joined_text

    marked = F.concat(F.lit("--- Seite "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    return joined_text(pages.filter(F.coalesce(F.col("text"), F.lit("")) != ""), ["file_id"], "page", marked, "\n\n")


def split_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line paragraphs: trimmed, with their index, cut to the longest length."""
    parts = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n\n")).alias("idx", text))
    return parts.withColumn(text, X.strip(text))


def requirements_from_pages(texts: DataFrame, limit: int | None = None, longest: int | None = None) -> DataFrame:
    """Paragraphs of each text that are long enough, numbered from 0; on request only the first `limit`, cut to `longest`."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), X.strip), lambda p: long_enough(p, V.PARAGRAPH_MIN_CHARS))
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    rows = texts.select("file_id", F.posexplode(parts).alias("idx", "text"))
    text = F.col("text") if longest is None else F.substring("text", 1, longest)
    return rows.select("file_id", F.format_string("ANF_%04d", "idx").alias("id"), text.alias("text"), "idx")


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))


def requirements_from_lines(texts: DataFrame) -> DataFrame:
    return text_lines(texts.select("file_id", "text")).filter(contains_any("line", V.LINE_REQUIREMENT_WORDS)).select(
        "file_id", F.format_string("REQ_OCR_%04d", "line_idx").alias("id"), X.strip("line").alias("text"),
        F.lit("allgemein").alias("category"), F.lit("mittel").alias("priority"), "line_idx")


def needs_scan(c: Column | str) -> Column:
    """Too little text: the file has to be read by character recognition."""
    return F.length(X.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))) < V.SCAN_TEXT_MIN_CHARS


# --- plan text -----------------------------------------------------------------

def plan_spaces(pages: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    label = F.col("number")
    return pages.select("file_id", "page", F.explode(X.space_labels("text", patterns)).alias("number")).select(
        "file_id", "page",
        F.concat(F.lit("Raum_"), F.replace(label, F.lit("."), F.lit("_"))).alias("id"),
        F.concat(F.lit("Raum "), label).alias("name"), "number")


def plan_systems(pages: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return pages.select("file_id", "page", F.posexplode(X.system_labels("text", patterns)).alias("nth", "s")).select(
        "file_id", "page", "nth",
        F.concat(F.lit("ANL_"), X.underscored("s.name"), F.lit("_"),
                 F.coalesce(or_null("s.number"), F.lit("1"))).alias("id"),
        F.col("s.name").alias("kind"),
        F.trim(F.concat_ws(" ", "s.name", "s.number")).alias("name"))


def matches_with_position(text: Column, pattern: str) -> Column:
    """array<struct<match, position>> of a pattern, positions from 0.

    Between two matches lies one piece of split(), so a position is the length of
    the pieces and matches before it.
    """
    p = "(?iu)" + pattern
    found = F.regexp_extract_all(text, F.lit(f"({p})" if not p.startswith("((") else p), F.lit(1))
    pieces = F.split(text, p, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,position:int>>").alias("out"))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                       lambda piece, m: F.struct(piece.alias("piece"), m.alias("m")))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + F.length(s["piece"])
        hit = F.array(F.struct(s["m"].alias("match"), at.alias("position")))
        return F.struct((at + F.length(s["m"])).alias("at"), F.concat(acc["out"], hit).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def plan_symbols(pages: DataFrame) -> DataFrame:
    """Symbol words as equipment or systems, with their position in the text."""
    def found(symbol: str, entity: str, pattern: str) -> Column:
        return F.transform(matches_with_position(F.col("text"), pattern), lambda m: F.struct(
            F.lit(symbol).alias("kind"), F.lit(entity).alias("entity"), m["match"].alias("name"),
            m["position"].alias("position")))

    hits = [found(symbol, entity, pattern) for symbol, (entity, pattern) in V.PLAN_SYMBOLS.items()]
    return pages.select("file_id", "page", F.inline(F.flatten(F.array(*hits)))).select(
        "file_id", "page",
        F.concat_ws("_", F.upper("entity"), "kind", F.col("page").cast("string"), F.col("position").cast("string")).alias("id"),
        "entity", "kind", "name", "position")


def plan_areas(pages: DataFrame) -> DataFrame:
    """Each area with the nearest space label before it in the text of the page."""
    def found(pattern: str, is_area: bool) -> Column:
        group = lambda m: F.regexp_extract(m["match"], "(?iu)" + pattern, 1)
        # the whole match is needed for positions, so its own group does not capture
        return F.transform(matches_with_position(F.col("text"), pattern.replace("(\\d", "(?:\\d")), lambda m: F.struct(
            m["position"].alias("position"),
            (F.lit(None).cast("string") if is_area else group(m)).alias("label"),
            (F.translate(group(m), ",", ".").try_cast("double") if is_area else F.lit(None).cast("double")).alias("area")))

    space = F.flatten(F.array(*[found(p, False) for p in V.AREA_OWNER_PATTERNS]))
    area = F.flatten(F.array(*[found(p, True) for p in V.AREA_PATTERNS]))
    # one page is one row of the input, so this window stays inside what one row held
    tokens = pages.select("file_id", "page", F.inline(F.concat(space, area)))
    w = Window.partitionBy("file_id", "page").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tokens.withColumn("number", F.last("label", ignorenulls=True).over(w))
        .filter("area is not null and number is not null")
        .select("file_id", "page", "number", F.col("area").alias("area_m2"), "position")
    )
