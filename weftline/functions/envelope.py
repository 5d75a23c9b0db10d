"""The focus envelope: JSON inside a context's surrounding text, valid only with its exact keys and types.

A strict check (keys, tag, types) decides what counts as an envelope in gates and features; a looser one (tag and parseable JSON)
serves the difficulty profile. The two differ on purpose. The format tag is a parameter of every function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.expr import nonblank, strip, utf16_length, utf16_substring

SCHEMA = "struct<format:string,selectionKnown:boolean,beforeSelection:string,afterSelection:string,textWindow:string,nearbyText:array<string>>"
#: The two key sets of a valid envelope: around a known selection, or a window of text.
KNOWN_KEYS = ("afterSelection", "beforeSelection", "format", "nearbyText", "selectionKnown")
WINDOW_KEYS = ("format", "nearbyText", "selectionKnown", "textWindow")
FORMAT = "focus-text-v1"


def parsed(text: Column) -> Column:
    return F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"})


def is_valid(text: Column, tag: str = FORMAT) -> Column:
    """Strict: format tag, boolean selectionKnown, exact key set, strings and an array of strings."""
    e, keys = parsed(text), F.array_sort(F.json_object_keys(text))
    known = (keys == F.array(*map(F.lit, KNOWN_KEYS))) & e["selectionKnown"] & e["beforeSelection"].isNotNull() & e["afterSelection"].isNotNull()
    window = (keys == F.array(*map(F.lit, WINDOW_KEYS))) & ~e["selectionKnown"] & e["textWindow"].isNotNull()
    listed = e["nearbyText"].isNotNull() & F.forall(e["nearbyText"], lambda x: x.isNotNull())
    return F.coalesce((e["format"] == tag) & listed & (known | window), F.lit(False))


def is_loose(text: Column, tag: str = FORMAT) -> Column:
    """Loose: the text parses and carries the tag."""
    return F.coalesce(parsed(text)["format"] == tag, F.lit(False))


def texts(text: Column) -> Column:
    """The envelope's non-null texts, in the order before, after, window, nearby."""
    e = parsed(text)
    return F.filter(F.concat(F.array(e["beforeSelection"], e["afterSelection"], e["textWindow"]), F.coalesce(e["nearbyText"], F.array().cast("array<string>"))), lambda x: x.isNotNull())


def has_semantic_context(label: Column, selected: Column, surrounding: Column) -> Column:
    """A nonblank label or selection, text inside a valid envelope, or any nonblank other text."""
    inside = F.exists(texts(surrounding), nonblank)
    return nonblank(label) | nonblank(selected) | F.when(is_valid(surrounding), inside).otherwise(nonblank(surrounding))


def duplicated_boundary(selected: Column, surrounding: Column) -> Column:
    """A known selection that stands again, alone, as the text before or after itself."""
    e = parsed(surrounding)
    before, after = (e["beforeSelection"] == selected) & (e["afterSelection"] == ""), (e["afterSelection"] == selected) & (e["beforeSelection"] == "")
    return F.coalesce((selected != "") & is_loose(surrounding) & e["selectionKnown"] & (before | after), F.lit(False))


def nearby_texts(values: Column, host: str | None = None) -> Column:
    """The first 4 texts, trimmed, distinct, at most 240 characters each and 600 in all, the last one cut to what is left; without the host's name as a word (P23). Characters are code points."""
    bare = (lambda x: F.regexp_replace(x, "(?i)(?<![\\p{L}\\p{N}])" + "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in host) + "(?![\\p{L}\\p{N}])", "")) if host else (lambda x: x)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(600).alias("left"))

    def add(a: Column, x: Column) -> Column:
        label = F.substring(strip(bare(x)), F.lit(1), F.least(F.lit(240), a["left"]))
        return F.when((a["left"] <= 0) | (label == "") | F.array_contains(a["kept"], label), a).otherwise(F.struct(F.concat(a["kept"], F.array(label)).alias("kept"), (a["left"] - F.length(label)).alias("left")))

    return F.aggregate(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, 4), start, add)["kept"]


def render(window: Column, start: Column, length: Column, selected: Column, nearby: Column, host: str | None = None, tag: str = FORMAT) -> Column:
    """The envelope of a focus (P23), keys in the format's own order; empty if there's no text at all.

    The selection is known if its UTF-16 range lies in the window's first 1,700 characters, splits no surrogate pair and holds the selected text.
    """
    text, near = F.substring(F.coalesce(window, F.lit("")), 1, 1700), nearby_texts(nearby, host)
    got = utf16_substring(text, start, length)
    known = F.coalesce(got == selected, F.lit(False))
    before, after = utf16_substring(text, F.lit(0), start), utf16_substring(text, start + length, utf16_length(text) - start - length)
    full = F.to_json(F.struct(F.lit(tag).alias("format"), F.lit(True).alias("selectionKnown"), before.alias("beforeSelection"), after.alias("afterSelection"), near.alias("nearbyText")))
    part = F.to_json(F.struct(F.lit(tag).alias("format"), F.lit(False).alias("selectionKnown"), text.alias("textWindow"), near.alias("nearbyText")))
    nothing = (text == "") & (F.size(near) == 0) & (F.coalesce(selected, F.lit("")) == "")
    return F.when(nothing, "").when(known, full).otherwise(part)
