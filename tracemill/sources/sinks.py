"""Outputs: tables, JSON, CSV, flame graphs as HTML, and masking of fields."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Maps are left out, collections joined by ` | `, arrays of numbers by `;`, structs as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            continue
        if isinstance(f.dataType, T.ArrayType):
            sep = ";" if isinstance(f.dataType.elementType, T.NumericType) else " | "
            text = lambda x, t=f.dataType.elementType: F.to_json(x) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")
            c = F.array_join(F.transform(c, text), sep)
        elif isinstance(f.dataType, T.StructType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes rows as a folder of json, csv (with a header) or parquet files."""
    if kind == "csv":
        flat_for_csv(df).write.option("header", True).csv(path)
    else:
        df.write.format(kind).save(path)


def show(df: DataFrame, limit: int = 50) -> str:
    """The first rows as an aligned table."""
    rows = [[("" if v is None else json.dumps(v.asDict(True), default=str) if hasattr(v, "asDict") else str(v)) for v in r] for r in df.take(limit)]
    wide = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)] if df.columns else []
    line = lambda r: "  ".join(x.ljust(n) for x, n in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * n for n in wide]), *map(line, rows)])


def flame_tree(nodes: DataFrame, limit: int = 100_000) -> dict:
    """The nested tree of flame_nodes() rows, of which the `limit` most frequent are taken to the driver."""
    root = {"name": "root", "value": 0, "children": {}}
    for r in nodes.orderBy(F.desc("count")).limit(limit).orderBy("depth").collect():
        at = root
        *above, name = r["path"].split(";")
        for a in above:
            at = at["children"].get(a)
            if at is None:
                break
        if at is not None:
            at["children"][name] = {"name": name, "value": r["count"], "children": {}}
            if not above:
                root["value"] += r["count"]
    return root


def flame_html(tree: dict, title: str = "Flame graph") -> str:
    """A page that draws the tree as nested boxes, without scripts."""

    def box(node: dict, total: int) -> str:
        inner = "".join(box(c, node["value"]) for c in sorted(node["children"].values(), key=lambda c: -c["value"]))
        wide = 100.0 * node["value"] / max(1, total)
        name = html.escape(node["name"])
        return f'<div class="n" style="width:{wide:.3f}%"><span title="{name} ({node["value"]})">{name}</span><div class="r">{inner}</div></div>'

    style = "body{font:12px sans-serif}.r{display:flex}.n{overflow:hidden;box-sizing:border-box}.n>span{display:block;background:#f4b266;border:1px solid #fff;white-space:nowrap;overflow:hidden}"
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1><div class='r'>{box(tree, tree['value'])}</div>"


def scrubbed(df: DataFrame, field: str, guard: str | None = None, pattern: str | None = None) -> DataFrame:
    """`field` overwritten by as many x where the guard field matches the whole pattern (or always)."""
    masked = F.repeat(F.lit("x"), F.length(field))
    hit = F.col(guard).cast("string").rlike(f"^(?:{pattern})$") if guard and pattern else F.lit(True)
    return df.withColumn(field, F.when(F.coalesce(hit, F.lit(False)), masked).otherwise(F.col(field)))
