"""Tables from extracted payloads whose shape differs from row to row (FN-25), by the VARIANT type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: List of a payload and columns of its table, by extraction type (fixed values). A table brings its own.
SHAPES = {
    "figures": ("figures", ("metric", "value", "unit", "context")), "entities": ("entities", ("id", "name", "type", "description")),
    "timeline": ("events", ("date_or_period", "event", "source_chunk_id")),
}


def table_cells(rows: DataFrame, key: str, kind: str, payload: str) -> DataFrame:
    """key, row_no, column_no (from 0), header and value (text, null where it is missing) of every cell.

    Payloads that are no JSON, of an unknown type or without their list have no cells; neither have rows of a table that are no
    lists. Cells beyond a table's headers have none.
    """
    parsed = rows.select(key, kind, F.try_parse_json(F.col(payload)).alias("v"))
    listed = lambda path: F.try_variant_get("v", f"$.{path}", "array<variant>")
    items = F.when(F.col(kind) == "table", listed("rows"))
    for name, (path, _) in SHAPES.items():
        items = items.when(F.col(kind) == name, listed(path))
    headers = F.when(F.col(kind) == "table", F.try_variant_get("v", "$.headers", "array<string>"))
    for name, (_, names) in SHAPES.items():
        headers = headers.when(F.col(kind) == name, F.array(*map(F.lit, names)))
    each = parsed.select(key, kind, headers.alias("headers"), F.posexplode(items).alias("row_no", "item"))
    own = F.try_variant_get("item", "$", "array<variant>")
    width = F.greatest(F.size(own), F.lit(0))
    fields = F.when(F.col(kind) == "table", F.transform(own, lambda v: F.try_variant_get(v, "$", "string")))
    for name, (_, names) in SHAPES.items():
        fields = fields.when(F.col(kind) == name, F.array(*[F.try_variant_get("item", f"$.{n}", "string") for n in names]))
    cells = each.where((F.col(kind) != "table") | (width > 0)).select(key, "row_no", "headers", F.posexplode(fields).alias("column_no", "value"))
    return cells.select(key, "row_no", "column_no", F.get("headers", F.col("column_no")).alias("header"), "value")
