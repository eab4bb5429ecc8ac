"""Entities from decoded tables: spreadsheet cells, document tables, layout tokens.

Cells become one row map per table row first (a row has a bounded number of
columns), so all later steps move rows, not cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import first_label, has_text, is_total_row, or_null
from plumbline.operators.ordered import renumber, stop_after_gap

SHEET = ["file_id", "sheet"]


def filled(value: Column, dtype: Column) -> Column:
    """A cell counts if it is not empty, zero or false."""
    text = F.coalesce(value, F.lit(""))
    zero = (dtype == "n") & (value.try_cast("double") == 0)
    false = (dtype == "b") & (F.lower(value) == "false")
    return (text != "") & ~F.coalesce(zero, F.lit(False)) & ~F.coalesce(false, F.lit(False))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, row, cells, any_text, any_value): cells is map<col, struct<value, dtype>>."""
    cell = F.struct("value", "dtype")
    has_value = filled(F.col("value"), F.col("dtype"))
    return cells.groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col"), cell))).alias("cells"),
        F.max(has_value & (X.strip("value") != "")).alias("any_text"),
        F.max(has_value).alias("any_value"),
        F.max(F.col("dtype") == "f").alias("any_formula"),
        F.max("col").alias("last_col"))


def _ordered(cells: Column) -> Column:
    return F.array_sort(F.map_entries(cells))


def _upto(rows: int | None) -> Column:
    return F.lit(True) if rows is None else F.col("row") <= rows


def sheet_layout(rows: DataFrame, header_rows: int | None = None, sample_rows: int | None = 5, formula_rows: int | None = None) -> DataFrame:
    """One row per sheet: header row, its cells, sample text, extent, formula flag.

    The header is looked for in the first `header_rows` rows, formulas in the first `formula_rows`, None for all; the
    text that tells a sheet's kind are its first `sample_rows` rows, as that rule has it.
    """
    header = F.when(F.col("any_text") & _upto(header_rows), F.col("row"))
    row_text = F.concat_ws(" ", F.transform(
        F.filter(_ordered(F.col("cells")), lambda e: filled(e["value"]["value"], e["value"]["dtype"])),
        lambda e: e["value"]["value"]))
    sample = F.collect_list(F.when(_upto(sample_rows), F.struct("row", row_text.alias("t"))))
    first = rows.groupBy(*SHEET).agg(
        F.coalesce(F.min(header), F.lit(1)).alias("header_row"),
        F.coalesce(F.min_by("cells", header), F.min_by("cells", F.when(F.col("row") == 1, F.col("row")))).alias("header_cells"),
        F.lower(F.concat_ws(" ", F.transform(F.array_sort(sample), lambda s: s["t"]))).alias("sample_text"),
        F.max("row").alias("max_row"), F.max("last_col").alias("max_col"),
        F.max(F.col("any_formula") & _upto(formula_rows)).alias("has_formulas"))
    kind = F.coalesce(first_label("sheet", V.SHEET_KINDS_BY_NAME), first_label("sample_text", V.SHEET_KINDS_BY_TEXT))
    return first.withColumn("kind", kind)


def header_list(header_cells: Column, max_col: Column) -> Column:
    """Header texts of columns 1..max_col with placeholders."""
    return F.transform(F.sequence(F.lit(1), max_col), lambda i: X.header_name(
        F.when(filled(F.try_element_at(header_cells, i)["value"], F.try_element_at(header_cells, i)["dtype"]),
               F.try_element_at(header_cells, i)["value"]), i))


def role_columns(header_cells: Column, roles: Mapping[str, Sequence[str]]) -> Column:
    """struct<role: column>: a header takes the first role that fits, a role its last header."""
    labelled = F.transform(
        F.filter(F.map_entries(header_cells), lambda e: (e["value"]["dtype"] == "s") & has_text(e["value"]["value"])),
        lambda e: F.struct(e["key"].alias("col"), first_label(e["value"]["value"], roles).alias("role")))
    def last_column(role: str) -> Column:
        return F.array_max(F.transform(F.filter(labelled, lambda x: x["role"] == role), lambda x: x["col"]))

    return F.struct(*[last_column(role).alias(role) for role in roles])


def _value(role: str) -> Column:
    cell = F.try_element_at(F.col("cells"), F.col(f"at.{role}"))
    return cell


def _text(role: str) -> Column:
    cell = _value(role)
    return F.when(filled(cell["value"], cell["dtype"]), X.strip(cell["value"]))


def _number(role: str) -> Column:
    cell = _value(role)
    return X.cell_number(cell["value"], cell["dtype"])


def data_rows(rows: DataFrame, layout: DataFrame, kind: str) -> DataFrame:
    """Rows below the header of the sheets of one kind, with the column of each role in `at`."""
    sheets = layout.filter(F.col("kind") == kind).select(
        *SHEET, "header_row", role_columns(F.col("header_cells"), V.SHEET_ROLES[kind]).alias("at"))
    return rows.join(sheets, SHEET).filter(
        F.col("row") > F.col("header_row"))


def spaces_from_sheets(rows: DataFrame, layout: DataFrame) -> DataFrame:
    name = F.col("name")
    return (
        data_rows(rows, layout, "raumliste").filter("at.name is not null")
        .select(*SHEET, "row", _text("name").alias("name"), _number("area").alias("area_m2"),
                _number("volume").alias("volume_m3"), _number("height").alias("height_m"),
                _text("usage").alias("usage"), _text("storey").alias("storey"), _text("zone").alias("zone"))
        .filter(has_text("name") & ~is_total_row("name", V.TOTAL_ROW_NAMES))
        .select(*SHEET, "row", F.concat(F.lit("Raum_"), X.underscored(name)).alias("id"), "name",
                name.alias("number"), "area_m2", "volume_m3", "height_m", "usage", "storey", "zone")
    )


def equipment_from_sheets(rows: DataFrame, layout: DataFrame) -> DataFrame:
    return (
        data_rows(rows, layout, "geraeteliste")
        .select(*SHEET, "row", F.coalesce(or_null(_text("name")), or_null(_text("kind"))).alias("name"),
                or_null(_text("kind")).alias("kind"), _number("power").alias("power_kw"),
                _text("system").alias("system_id"), _text("space").alias("space_id"))
        .filter(has_text("name"))
        .select(*SHEET, "row",
                F.concat_ws("_", F.lit("GER"), X.underscored("name"), F.col("row").cast("string")).alias("id"),
                F.coalesce("kind", "name").alias("kind"), "name", "power_kw", "system_id", "space_id")
    )


def systems_from_sheets(rows: DataFrame, layout: DataFrame) -> DataFrame:
    return (
        data_rows(rows, layout, "anlagenliste")
        .select(*SHEET, "row", F.coalesce(or_null(_text("name")), or_null(_text("kind"))).alias("name"),
                or_null(_text("kind")).alias("kind"), _number("power").alias("power_kw"), _number("flow").alias("flow_m3h"))
        .filter(has_text("name"))
        .select(*SHEET, "row",
                F.concat_ws("_", F.lit("ANL"), X.underscored("name"), F.col("row").cast("string")).alias("id"),
                F.coalesce("kind", "name").alias("kind"), "name", "power_kw", "flow_m3h")
    )


def milestones_from_sheets(rows: DataFrame, layout: DataFrame) -> DataFrame:
    due = _value("due")
    return (
        data_rows(rows, layout, "terminplan").filter("at.text is not null")
        .select(*SHEET, "row", _text("text").alias("text"),
                F.when(filled(due["value"], due["dtype"]), X.cell_text(due["value"], due["dtype"])).alias("due"),
                F.coalesce(or_null(_text("category")), F.lit("Meilenstein")).alias("category"), _text("phase").alias("phase"))
        .filter(has_text("text"))
        .select(*SHEET, "row", F.format_string("TERM_%04d", "row").alias("id"), "text", "due", "category", "phase")
    )


def services_from_sheets(rows: DataFrame, layout: DataFrame) -> DataFrame:
    return (
        data_rows(rows, layout, "leistungsverzeichnis").filter("at.text is not null")
        .select(*SHEET, "row", _text("text").alias("text"), _text("unit").alias("unit"),
                _number("quantity").alias("quantity"), _text("phase").alias("phase"), _text("category").alias("category"))
        .filter(has_text("text"))
        .select(*SHEET, "row", F.format_string("LEIST_%04d", "row").alias("id"), "text", "unit", "quantity", "phase", "category")
    )


# --- raw capture ------------------------------------------------------------------

def raw_rows(rows: DataFrame, layout: DataFrame, row_limit: int | None = None, empty_stop: int | None = None) -> DataFrame:
    """All data rows as header -> text maps up to the first long gap; equal headers: the last wins.

    With `row_limit`, rows further below the header are left out; with `empty_stop`, all that comes after so many
    empty rows. A sheet whose header row is all it has gives that row itself.
    """
    sheets = layout.select(*SHEET, "header_row", "max_row", header_list(F.col("header_cells"), F.col("max_col")).alias("headers"))
    sheets = sheets.withColumn("start", F.when(F.col("header_row") < F.col("max_row"), F.col("header_row") + 1).otherwise(F.col("header_row")))
    joined = rows.join(sheets, SHEET)
    in_range = joined.filter(
        F.col("any_value") & (F.col("row") >= F.col("start"))
        & (F.lit(True) if row_limit is None else F.col("row") <= F.col("start") + row_limit))
    kept = in_range if empty_stop is None else stop_after_gap(in_range, SHEET, "row", F.col("start"), empty_stop)
    # nothing below the header: the header row stands in
    some = kept.select(*SHEET).distinct()
    header_only = joined.filter((F.col("row") == F.col("header_row")) & F.col("any_value")).join(some, SHEET, "left_anti")

    last_of = F.array_distinct(F.reverse("headers"))
    values = F.transform(last_of, lambda h: F.struct(h.alias("h"), F.try_element_at(
        F.col("cells"), F.size("headers") - F.array_position(F.reverse("headers"), h).cast("int") + 1).alias("c")))
    mapped = F.map_from_entries(F.transform(values, lambda v: F.struct(v["h"], X.cell_text(v["c"]["value"], v["c"]["dtype"]))))
    return kept.unionByName(header_only).select(*SHEET, "row", "header_row", mapped.alias("values"))


def raw_table_summary(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """Row and column counts per raw table."""
    counts = raw.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.join(layout.select(*SHEET, "header_row", F.col("max_col").cast("long").alias("column_count")), SHEET)


def loose_cells(cells: DataFrame, layout: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Text outside the table: above the header row, or past the rows that belong to the table if they are limited."""
    bounds = layout.select(*SHEET, "header_row")
    text = X.strip("value")
    return (
        cells.join(bounds, SHEET)
        .filter((F.col("row") < F.col("header_row")) | (F.lit(False) if row_limit is None else F.col("row") > F.col("header_row") + row_limit))
        .select(*SHEET, "row", "col", text.alias("content"), X.cell_reference("col", "row").alias("cell"))
        .filter(F.length("content") >= 2)
    )


def loose_cells_after_stop(cells: DataFrame, rows: DataFrame, layout: DataFrame, empty_stop: int = V.EMPTY_ROW_STOP) -> DataFrame:
    """Text above the header row and text past the first long gap."""
    raw = raw_rows(rows, layout, empty_stop=empty_stop).select(*SHEET, "row", "header_row")
    last = raw.groupBy(*SHEET).agg(F.max("row").alias("_last"))
    bounds = layout.select(*SHEET, "header_row").join(last, SHEET, "left")
    return (
        cells.join(bounds, SHEET)
        .filter((F.col("row") < F.col("header_row")) | (F.col("row") > F.coalesce("_last", "header_row")))
        .select(*SHEET, "row", "col", X.strip("value").alias("content"), X.cell_reference("col", "row").alias("cell"))
        .filter(F.length("content") >= 2)
    )


# --- tables of documents and layouts -------------------------------------------------

TABLE = ["file_id", "table_idx"]


def document_rows(cells: DataFrame) -> DataFrame:
    """(file_id, table_idx, row, values): trimmed texts of one table row in column order."""
    return cells.groupBy(*TABLE, "row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("col", X.strip(F.coalesce("text", F.lit(""))).alias("t")))), lambda s: s["t"]).alias("values"))


def layout_rows(tokens: DataFrame, band: int = 20) -> DataFrame:
    """Tokens in bands of equal height become table rows in reading order; a band needs two tokens."""
    bands = tokens.filter(F.trim("text") != "").groupBy("file_id", "page", F.floor(F.col("top") / band).alias("band")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda s: s["text"]).alias("values"))
    rows = renumber(bands.filter(F.size("values") >= 2), ["file_id", "page"], "band", "n")
    return rows.select("file_id", F.col("page").alias("table_idx"), (F.col("n") - 1).cast("int").alias("row"), "values")


def layout_lines(tokens: DataFrame, band: int = 20) -> DataFrame:
    """Text lines in reading order: by band, then by left edge."""
    return tokens.filter(F.trim("text") != "").groupBy("file_id", "page", F.floor(F.col("top") / band).alias("band")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda s: s["text"])).alias("line"),
        F.count(F.lit(1)).alias("tokens"))


def _document_tables(rows: DataFrame, kind: str) -> DataFrame:
    head = rows.filter("row = 0").select(*TABLE, F.transform("values", F.lower).alias("headers"))
    kinds = head.withColumn("kind", first_label(F.array_join("headers", " "), V.DOCUMENT_TABLE_KINDS))
    body = rows.filter("row > 0").join(kinds.filter(F.col("kind") == kind), TABLE)
    paired = F.zip_with("headers", F.slice("values", F.lit(1), F.size("headers")), lambda h, v: F.struct(
        first_label(h, V.DOCUMENT_TABLE_ROLES[kind]).alias("role"), v.alias("v")))
    return body.filter(F.size("values") >= F.size("headers")).select(*TABLE, "row", paired.alias("cells"))


def _last(role: str) -> Column:
    return F.try_element_at(F.filter("cells", lambda c: c["role"] == role), F.lit(-1))["v"]


def _last_number(role: str) -> Column:
    parsed = F.transform(F.filter("cells", lambda c: c["role"] == role), lambda c: X.strict_number(c["v"]))
    return F.try_element_at(F.filter(parsed, lambda x: x.isNotNull()), F.lit(-1))


def _row_id(prefix: Column) -> Column:
    return F.concat_ws("_", prefix, F.col("table_idx").cast("string"), F.col("row").cast("string"))


def spaces_from_documents(rows: DataFrame) -> DataFrame:
    return _document_tables(rows, "spaces").select(
        *TABLE, "row", _last("name").alias("name"), _last_number("area").alias("area_m2"), _last("usage").alias("usage"),
    ).filter(has_text("name")).withColumn("id", _row_id(F.concat(F.lit("Raum_"), X.underscored("name"))))


def equipment_from_documents(rows: DataFrame) -> DataFrame:
    return _document_tables(rows, "equipment").select(
        *TABLE, "row", _last("name").alias("name"), _last("kind").alias("kind"), _last_number("power").alias("power_kw"),
    ).filter(has_text("name") | has_text("kind")).withColumn("id", _row_id(F.lit("GER"))).withColumn(
        "kind", F.coalesce(or_null("kind"), "name"))


def milestones_from_documents(rows: DataFrame) -> DataFrame:
    return _document_tables(rows, "milestones").select(
        *TABLE, "row", _last("text").alias("text"), _last("due").alias("due"),
    ).filter(has_text("text")).withColumn("id", _row_id(F.lit("TERM")))


def raw_document_rows(rows: DataFrame) -> DataFrame:
    """Document table rows as header -> text maps; rows without any text are dropped."""
    head = rows.filter("row = 0").select(*TABLE, F.transform("values", lambda h, i: X.header_name(h, i + 1)).alias("headers"))
    body = rows.filter("row > 0").join(head, TABLE).filter(F.exists("values", lambda v: v != ""))
    cut = F.slice("values", F.lit(1), F.size("headers"))
    heads = F.slice("headers", F.lit(1), F.size(cut))
    last_of = F.array_distinct(F.reverse(heads))
    mapped = F.map_from_arrays(last_of, F.transform(last_of, lambda h: F.try_element_at(
        cut, F.size(heads) - F.array_position(F.reverse(heads), h).cast("int") + 1)))
    return body.select(*TABLE, "row", mapped.alias("values"))
