"""Scalar functions on text, numbers and names. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import col, first_label, or_null

STRICT_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MARKER = r"\[Datei: ([^\]]+)\]"


def strip(c: Column | str) -> Column:
    """Trim all white space, not blanks only."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- files ---------------------------------------------------------------------

def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"[^./](\.[^./]*)$", 1))


def file_type(ext: Column | str, mime: Column | str | None = None) -> Column:
    def lookup(table: dict[str, str], key: Column) -> Column:
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), key)

    found = lookup(V.FILE_TYPE_BY_EXTENSION, F.lower(col(ext)))
    if mime is not None:
        found = F.coalesce(found, lookup(V.FILE_TYPE_BY_MIME, col(mime)))
    return F.coalesce(found, F.lit("Unknown"))


def document_type(name: Column | str) -> Column:
    return first_label(name, V.DOCUMENT_TYPES)


def discipline(name: Column | str) -> Column:
    return first_label(name, V.DISCIPLINES)


def revision(name: Column | str) -> Column:
    return F.coalesce(*[or_null(F.regexp_extract(col(name), p, 1)) for p in V.REVISION_PATTERNS])


def safe_file_name(c: Column | str) -> Column:
    return F.translate(col(c), '/\\:*?"<>|', "_" * 9)


def image_format(content: Column | str) -> Column:
    head = F.hex(F.substring(col(content), 1, 8))
    return (
        F.when(head.startswith("FFD8"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("424D"), "bmp")
        .otherwise("unknown")
    )


# --- numbers ----------------------------------------------------------------------

def tolerant_number(c: Column | str) -> Column:
    """First run of digits and points; the whole run must be one number."""
    run = F.regexp_extract(F.translate(col(c), ",", "."), "[0-9.]+", 0)
    return run.try_cast("double")


def strict_number(c: Column | str) -> Column:
    """The whole cell must be one number; a comma counts as a point."""
    text = F.replace(strip(c), F.lit(","), F.lit("."))
    return F.when(text.rlike(STRICT_NUMBER), text.try_cast("double"))


def cell_number(value: Column, dtype: Column) -> Column:
    """Number of a decoded cell: typed numbers as they are, text by the tolerant rule."""
    return (
        F.when(dtype == "n", value.try_cast("double"))
        .when(dtype == "b", value.try_cast("boolean").cast("double"))
        .when(dtype == "s", tolerant_number(value))
    )


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down for negative numbers too."""
    return F.floor(a / F.lit(b))


def column_letters(index: Column | str) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to three letters."""
    zero = col(index).cast("int") - 1
    one = F.chr(F.lit(65) + F.pmod(zero, F.lit(26)))
    two = F.chr(F.lit(65) + F.pmod(floor_div(zero, 26) - 1, F.lit(26)))
    three = F.chr(F.lit(65) + F.pmod(floor_div(zero - 26, 676) - 1, F.lit(26)))
    return F.concat(
        F.when(zero >= 702, three).otherwise(""), F.when(zero >= 26, two).otherwise(""), one
    )


def cell_reference(column: Column | str, row: Column | str) -> Column:
    return F.concat(column_letters(column), col(row).cast("string"))


def estimated_tokens(a: Column, b: Column) -> Column:
    return floor_div(F.length(a) + F.length(b), 4)


def percent(message: Column | str) -> Column:
    return F.regexp_extract(col(message), r"(\d+)%", 1).try_cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(part * 100.0, whole)))


# --- names and keys ------------------------------------------------------------------

def underscored(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(" "), F.lit("_"))


def header_name(c: Column, position: Column) -> Column:
    """Header text, or a placeholder with the 1-based position."""
    return F.coalesce(or_null(strip(c)), F.concat(F.lit("Spalte_"), position.cast("string")))


def cell_text(value: Column, dtype: Column | None = None) -> Column:
    """Text of a cell; nothing is empty text, points in time are ISO text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if dtype is None:
        return text
    moment = F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.when(dtype == "d", moment), text)


def project_number(description: Column | str) -> Column:
    """Number after the label, cut at a colon; without the label the plain number form."""
    text = col(description)
    label = r"(?i)Projektnummer:\s*([^\n\r]+)"
    labelled = strip(F.split_part(F.regexp_extract(text, label, 1), F.lit(":"), F.lit(1)))
    bare = F.regexp_extract(text, r"\d{4}-\d{2}-[A-Z]+", 0)
    return or_null(F.when(text.rlike(label), labelled).otherwise(bare))


def project_number_line(description: Column | str) -> Column:
    """Form used for sorting: the rest of the line, or empty text."""
    return strip(F.coalesce(F.regexp_extract(col(description), r"Projektnummer:\s*(.+)", 1), F.lit("")))


# --- requirements ----------------------------------------------------------------------

def requirement_priority(c: Column | str) -> Column:
    return first_label(c, V.PRIORITY_WORDS, default="mittel")


def requirement_category(c: Column | str) -> Column:
    return first_label(c, V.REQUIREMENT_CATEGORIES, default="allgemein")


def phase_of(c: Column | str) -> Column:
    """Phase words win over a number, even if both are there."""
    lowered = F.lower(col(c))
    numbered = [or_null(F.regexp_extract(lowered, p, 1)) for p in (r"sia\s*(\d+)", r"phase\s*(\d+)")]
    return F.coalesce(first_label(c, V.PHASE_WORDS), F.concat(F.lit("SIA "), F.coalesce(*numbered)))


# --- normalisation of ratings ---------------------------------------------------------------

def rating(c: Column | str) -> Column:
    known = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.when(known.isin("rot", "orange", "grün"), known).otherwise(
        first_label(known, {"rot": ["rot"], "orange": ["orange"], "grün": ["grün", "gruen"]}, default="orange")
    )


def priority(c: Column | str) -> Column:
    known = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.when(known.isin("hoch", "mittel", "niedrig"), known).otherwise(
        first_label(known, {"hoch": ["hoch", "high"], "niedrig": ["niedrig", "low"]}, default="mittel")
    )


def without_fence(c: Column | str) -> Column:
    """Drop a code fence around the text: its first line and a closing fence line."""
    def bare(text: Column) -> Column:
        opened = F.regexp_replace(text, r"(?s)\A[^\n]*(\n|\z)", "")
        closed = F.regexp_replace(opened, r"(\A|\n)[ \t\r]*```[ \t\r]*\z", "")
        return F.when(text.startswith("```"), closed).otherwise(text)

    return let(strip(c), bare)


# --- labels in plan text ----------------------------------------------------------------------

def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(group))


def space_labels(c: Column | str, patterns: list[str] | None = None) -> Column:
    return F.array_distinct(F.flatten(F.array(*[_all(col(c), p, 1) for p in patterns or V.SPACE_LABEL_PATTERNS])))


def area_values(c: Column | str) -> Column:
    found = F.flatten(F.array(*[_all(col(c), p, 1) for p in V.AREA_PATTERNS]))
    return F.transform(found, lambda v: F.translate(v, ",", ".").try_cast("double"))


def system_labels(c: Column | str, patterns: list[str] | None = None) -> Column:
    """(name, number) of each label, pattern by pattern; number is empty if not given."""
    def hits(p: str) -> Column:
        return F.zip_with(
            _all(col(c), p, 1), _all(col(c), p, 2),
            lambda n, k: F.struct(n.alias("name"), F.coalesce(k, F.lit("")).alias("number")),
        )
    return F.flatten(F.array(*[hits(p) for p in patterns or V.SYSTEM_LABEL_PATTERNS]))


# --- source markers -------------------------------------------------------------------------------

def source_marker(file: Column, para: Column | None = None) -> Column:
    """`[Datei: name, Absatz n]`, n counts from 1."""
    name = F.coalesce(file, F.lit("Unbekannte Datei"))
    tail = F.lit("") if para is None else F.coalesce(
        F.concat(F.lit(", Absatz "), (para + 1).cast("string")), F.lit(""))
    return F.concat(F.lit("[Datei: "), name, tail, F.lit("]"))


def marker_file(body: Column) -> Column:
    return strip(F.split_part(body, F.lit(", Absatz"), F.lit(1)))


def marker_para(body: Column) -> Column:
    text = strip(F.regexp_extract(body, r"(?s), Absatz(.*)\z", 1))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def citation(file: Column, para: Column) -> Column:
    """`name, Absatz n` with either part missing if unknown."""
    return F.concat_ws(", ", or_null(file), F.concat(F.lit("Absatz "), para.cast("string")))


# --- texts for reports ---------------------------------------------------------------------------

def teaser(c: Column | str, n: int = 50) -> Column:
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))


def german_date(c: Column | str) -> Column:
    return F.date_format(col(c), "dd.MM.yyyy")


def team_size(spaces: Column, systems: Column) -> Column:
    zero = F.lit(0).cast("long")
    return (F.lit(2).cast("long") + F.greatest(zero, floor_div(spaces - 10, 20))
            + F.greatest(zero, floor_div(systems - 5, 5)))


def engineers(team: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), team - 1)


def drafters(team: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), floor_div(team, 2))


def _shortened(c: Column, longest: int) -> Column:
    """Cut at the last sentence end if that keeps most of the text, else with dots."""
    def cut(whole: Column) -> Column:
        head = F.substring(whole, 1, longest)
        upto = F.length(F.regexp_extract(head, r"(?s)\A.*[.!?]", 0))
        return F.when(F.length(whole) <= longest, whole).otherwise(let(upto, lambda n: F.when(
            n - 1 > longest * 0.7, F.left(head, n)).otherwise(F.concat(head, F.lit("...")))))

    return let(strip(F.coalesce(c, F.lit(""))), cut)


def _bullet_points(lines: Column) -> Column:
    plain = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[-•*·]\s*", ""), r"^\d+[.)]\s*", ""))
    return F.filter(plain, lambda s: s != "")


def _sentence_groups(text: Column, points: int) -> Column:
    """Sentences, short ones joined to the one before; what is too much goes into the last group."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+\s+"), strip), lambda s: s != "")

    def fold(groups: Column, s: Column) -> Column:
        joined = F.concat(
            F.slice(groups, F.lit(1), F.size(groups) - 1),
            F.array(F.concat(F.try_element_at(groups, F.lit(-1)), F.lit(" "), s)))
        return F.when((F.length(s) < 30) & (F.size(groups) > 0), joined).otherwise(F.concat(groups, F.array(s)))

    def limit(groups: Column) -> Column:
        rest = F.array_join(F.slice(groups, F.lit(points), F.greatest(F.size(groups), F.lit(1))), " ")
        return F.when(F.size(groups) > points, F.concat(F.slice(groups, 1, points - 1), F.array(rest))).otherwise(groups)

    return let(F.aggregate(sentences, F.array().cast("array<string>"), fold), limit)


def overview_bullets(c: Column | str, longest: int = 400, points: int = 5, point_chars: int = 200) -> Column:
    """Short list of points from an assessment; an existing list is kept as it is."""
    def choose(text: Column) -> Column:
        def pick(lines: Column) -> Column:
            bulleted = F.exists(lines, lambda s: s.rlike(r"^[-•*·]") | ((F.length(s) > 2) & s.rlike(r"^\d[.):]")))
            return F.when(bulleted, F.slice(_bullet_points(lines), 1, points)).otherwise(_sentence_groups(text, points))

        return let(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != ""), pick)

    tidy = F.transform(let(_shortened(col(c), longest), choose), lambda s: F.regexp_replace(strip(s), r"\s+", " "))
    short = F.transform(tidy, lambda s: F.when(
        F.length(s) > point_chars, F.concat(F.substring(s, 1, point_chars - 3), F.lit("..."))).otherwise(s))
    return F.filter(short, lambda s: s != "")
