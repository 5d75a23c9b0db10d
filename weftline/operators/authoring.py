"""Author drafts into raw fixtures: field profiles by family, candidate spaces, and compilation with its checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.operators.gates import MAX_CANDIDATES, first_problem

# Field profiles (P16), fixed values: families, or what families begin with (*), then category, role, label, source, guidance.
PROFILES = (
    (("file_listing", "literal_text_search", "directory_creation", "file_copy_destination", "disk_usage", "process_inspection", "process_signal", "git_branch_listing", "git_commit_inspection", "git_remote_configuration",
      "git_diff_selection", "git_tag_version"), "development", "AXTextArea", "Shell command", "browser", ("Paste one complete shell command.",)),
    (("http_method",), "development", "AXTextField", "HTTP method", "browser", ()),
    (("http_authentication", "http_content_type", "regex_character_class", "configuration_boolean"), "development", "AXTextField", "Value", "browser", ()),
    (("python_*", "javascript_*", "swift_*", "sql_*"), "development", "AXTextArea", "Code editor", "development", ("Paste a complete code snippet.",)),
    (("document_export_format",), "mail", "AXGroup", "Attachments", "file_management", ("Paste files here to attach them.",)),
    (("design_image_dimensions",), "creative", "AXGroup", "Image canvas", "creative", ("Paste a copied image onto this canvas.",)),
    (("design_vector_raster",), "creative", "AXGroup", "Design canvas", "creative", ("Paste SVG markup or a PNG image onto this canvas.",)),
    (("design_color_syntax",), "creative", "AXTextField", "Color value", "creative", ()),
    (("email_recipient_address",), "mail", "AXTextField", "To", "mail", ()),
    (("email_subject_summary",), "mail", "AXTextField", "Subject", "mail", ()),
    (("chat_*",), "messaging", "AXTextArea", "Message composer", "messaging", ()),
    (("spreadsheet_*",), "spreadsheet", "AXTextField", "Cell", "spreadsheet", ()),
    (("url_*",), "browser", "AXTextField", "Address", "browser", ()),
    (("path_absolute_relative",), "file_management", "AXTextField", "File path", "file_management", ()),
    (("contact_postal_address",), "browser", "AXTextArea", "Postal address", "writing", ()),
    (("writing_concise_summary", "writing_bulleted_outline", "translation_target_language", "markdown_link"), "writing", "AXTextArea", "Text editor", "writing", ()),
)
# Families with a small fixed vocabulary (P16), and the category that shows a field in another application.
SMALL_SPACES, SMALL, WIDE = ("http_method", "configuration_boolean", "calendar_rsvp_status"), 4, MAX_CANDIDATES
ALTERNATE_CATEGORY = {"development": "browser", "spreadsheet": "development", "unknown": "browser", "browser": "writing", "writing": "browser", "mail": "writing", "creative": "writing"}


def is_one_of(family: Column, names: tuple[str, ...]) -> Column:
    """Whether a family is listed, or begins with a listed front."""
    out = family.isin(*[n for n in names if not n.endswith("*")])
    for n in names:
        if n.endswith("*"):
            out = out | F.startswith(family, F.lit(n[:-1]))
    return out


def field_profile(family: Column, alternate: Column | None = None) -> Column:
    """The family's field: applicationCategory, fieldRole, fieldLabel, sourceCategory, staticGuidance; null for a family without one. alternate: whether another application hosts it."""
    out = None
    for names, category, role, label, source, guidance in PROFILES:
        shown = F.lit(category)
        if alternate is not None:
            shown = F.when(alternate & F.lit(category in ALTERNATE_CATEGORY), ALTERNATE_CATEGORY.get(category, category)).otherwise(category)
        help_ = F.array(*map(F.lit, guidance)) if guidance else F.array().cast("array<string>")
        row = F.struct(shown.alias("applicationCategory"), F.lit(role).alias("fieldRole"), F.lit(label).alias("fieldLabel"), F.lit(source).alias("sourceCategory"), help_.alias("staticGuidance"))
        out = F.when(is_one_of(family, names), row) if out is None else out.when(is_one_of(family, names), row)
    return out


def candidate_space(family: Column) -> Column:
    """(least, most) candidates of a family, declared before any label."""
    return F.struct(F.lit(1).alias("least"), F.when(family.isin(*SMALL_SPACES), SMALL).otherwise(WIDE).alias("most"))


def draft_problem(item: Column, count: Column, profile: Column) -> Column:
    """The first reason why an author's item can't be compiled. item: guidance, selected, candidates array<struct<text, file, image>> with one field set."""
    kinds = F.transform(item["candidates"], lambda c: c["text"].isNotNull().cast("int") + c["file"].isNotNull().cast("int") + c["image"].isNotNull().cast("int"))
    size = lambda c: F.size(c["image"])
    return first_problem(
        (profile.isNull(), "no_profile"), (item["guidance"].isNull() | (F.size(item["guidance"]) > 2) | F.exists(item["guidance"], lambda g: g.isNull() | (F.length(g) > 240)), "guidance"),
        (item["selected"].isNull() | (F.length(item["selected"]) > 1200), "selected"), (item["candidates"].isNull() | (F.size(item["candidates"]) != count) | ~count.between(1, MAX_CANDIDATES), "candidate_count"),
        (F.size(profile["staticGuidance"]) + F.size(item["guidance"]) > 4, "nearby"), (F.exists(kinds, lambda k: k != 1), "candidate"), (F.exists(item["candidates"], lambda c: c["image"].isNotNull() & (size(c) != 2)), "image_size"),
    )


def compiled(item: Column, profile: Column) -> Column:
    """The raw fixture of an item that has no draft_problem(): context, capture, entries with payloads."""
    context = F.struct(
        profile["applicationCategory"].alias("applicationCategory"), profile["fieldLabel"].alias("fieldLabel"), profile["fieldRole"].alias("fieldRole"), F.lit(True).alias("hasAccessibility"), F.lit("unknown").alias("inputSurface"),
        F.lit(False).alias("isSecure"), item["selected"].alias("selectedText"), F.lit("").alias("surroundingText"),
    )
    capture = F.struct(F.lit("").alias("beforeSelection"), F.lit("").alias("afterSelection"), F.concat(profile["staticGuidance"], item["guidance"]).alias("nearbyText"))
    kind = lambda c: F.when(c["text"].isNotNull(), "text").when(c["file"].isNotNull(), "file").otherwise("image")
    payload = lambda c: F.struct(kind(c).alias("type"), c["text"].alias("text"), c["file"].alias("names"), F.get(c["image"], F.lit(0)).alias("width"), F.get(c["image"], F.lit(1)).alias("height"))
    entries = F.transform(item["candidates"], lambda c, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("id"), profile["sourceCategory"].alias("sourceCategory"), payload(c).alias("payload")))
    return F.struct(context.alias("context"), capture.alias("capture"), entries.alias("entries"))


def entry_text(payload: Column) -> Column:
    """What a model sees of a payload: its text, file names by line, or an image's size."""
    size = F.concat(F.lit("图片 · "), payload["width"].cast("string"), F.lit(" × "), payload["height"].cast("string"), F.lit(" 像素"))
    return F.when(payload["type"] == "text", payload["text"]).when(payload["type"] == "file", F.array_join(payload["names"], "\n")).otherwise(size)
