"""JSON object text: rewriting single fields while the rest keeps its order and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webjourney.functions.text import let


def quoted(c: Column) -> Column:
    """A text as a JSON string literal, NULL as ``null``."""
    body = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(c.isNull(), F.lit("null")).otherwise(body)


def typed_entries(text: Column) -> Column:
    """``array<struct<key,text,kind>>`` of an object in its own order.

    ``text`` is the unquoted value, ``kind`` its variant type (STRING, OBJECT<…>, VOID …).
    """
    texts = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.map_values(F.from_json(text, "map<string,variant>"))
    return F.zip_with(texts, typed, lambda e, v: F.struct(
        e["key"].alias("key"), e["value"].alias("text"),
        F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("kind")))


def raw_text(e: Column) -> Column:
    """JSON text of a typed entry."""
    return F.when(e["kind"] == "STRING", quoted(e["text"])).otherwise(F.coalesce(e["text"], F.lit("null")))


def object_text(items: Column) -> Column:
    """Object text from ``array<struct<key,raw>>``."""
    parts = F.transform(items, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["raw"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def set_fields(payload: Column, raw: dict[str, Column]) -> Column:
    """Top-level fields set to the given JSON texts, in place or appended."""
    def rewritten(entries: Column) -> Column:
        def item(e: Column) -> Column:
            value = raw_text(e)
            for name, text in raw.items():
                value = F.when(e["key"] == name, text).otherwise(value)
            return F.struct(e["key"].alias("key"), value.alias("raw"))

        out = F.transform(entries, item)
        for name, text in raw.items():
            missing = ~F.exists(entries, lambda e: e["key"] == name)
            extra = F.array(F.struct(F.lit(name).alias("key"), text.alias("raw")))
            out = F.concat(out, F.filter(extra, lambda _: missing))
        return object_text(out)

    return let(typed_entries(payload), rewritten)
