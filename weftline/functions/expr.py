"""Scalar expressions shared by the operators, all built-in columns: ratios, intervals, hashes, canonical JSON, text classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution, a fixed value.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for an empty denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clipped to [0, 1]; null without observations (A5)."""
    p, count = ratio(successes, n), n.cast("double")
    d = 1 + F.try_divide(F.lit(z * z), count)
    centre = (p + F.try_divide(F.lit(z * z), 2 * count)) / d
    reach = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), count) + F.try_divide(F.lit(z * z), 4 * count * count)) / d
    some = p.isNotNull()
    return F.when(some, F.greatest(F.lit(0.0), centre - reach)), F.when(some, F.least(F.lit(1.0), centre + reach))


def flag(c: Column) -> Column:
    """A boolean as 0 or 1, null as 0."""
    return F.coalesce(c, F.lit(False)).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nonblank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def hash_int(text: Column, digits: int = 12) -> Column:
    """The first hex digits of SHA-256 as an integer (up to 15 digits fit)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def hash_unit(text: Column) -> Column:
    """MD5's first 32 bits as a fraction of 2**32."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sigmoid(v: Column) -> Column:
    """The logistic function in two branches, so neither overflows."""
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b))


def same_action(a: Column, b: Column) -> Column:
    """Labels agree: one decision, one set of ids, one reason, where ambiguous and insufficient_context count as one."""
    intent = lambda r: F.when(r.isin("ambiguous", "insufficient_context"), "missing_intent").otherwise(F.coalesce(r, F.lit("")))
    return (a["decision"] == b["decision"]) & (F.array_sort(a["acceptable_ids"]) == F.array_sort(b["acceptable_ids"])) & (intent(a["abstain_reason"]) == intent(b["abstain_reason"]))


def action_bucket(decision: Column, reason: Column) -> Column:
    """select, no_match or missing_intent."""
    return F.when(decision == "select", "select").when(reason == "no_match", "no_match").otherwise("missing_intent")


def count_bucket(n: Column) -> Column:
    """The candidate-count bucket."""
    return F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 10, "5-10").otherwise("11-20")


def canonical_json(struct: Column) -> Column:
    """Compact JSON with nulls, of a struct whose fields stand in ASCII order; control characters are escaped in lower case."""
    text = F.to_json(struct, {"ignoreNullFields": "false"})
    for code in (*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20)):
        if f"{code:04X}" != f"{code:04x}":
            text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return text


def visible_body(context: Column, entries: Column, with_ids: bool) -> Column:
    """What a reader of an episode sees, as canonical JSON: with entry ids and order, or without both."""
    if with_ids:
        return canonical_json(F.struct(context.alias("context"), entries.alias("entries")))
    parts = F.array_sort(F.transform(entries, lambda e: canonical_json(e.dropFields("id"))))
    return F.concat(F.lit('{"context":'), canonical_json(context), F.lit(',"entries":['), F.array_join(parts, ","), F.lit("]}"))


def content_fingerprint(context: Column, entries: Column) -> Column:
    """SHA-256 of the visible content, whatever the entries' ids and order."""
    return F.sha2(visible_body(context, entries, False), 256)


def visible_sha256(context: Column, entries: Column) -> Column:
    return F.sha2(visible_body(context, entries, True), 256)


# Fixed values of the text classes (P20).
COMMAND_STARTS = ("$ ", "git ", "sudo ", "npm ", "npx ", "brew ", "python ", "python3 ", "curl ", "swift ", "cd ", "ls ", "ssh ", "docker ", "make ", "xcodebuild ")
CODE_STARTS = ("import ", "func ", "let ", "const ", "def ", "class ", "struct ", "SELECT ", "#!/")


def text_kind(text: Column) -> Column:
    """color, email, url, phone, command, code or text; the first that fits. A URL is a known scheme followed by no white space."""
    t = strip(text)
    starts = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.startswith(t, x))
    return (
        F.when(t.rlike("^#[0-9a-fA-F]{3,8}$"), "color")
        .when(t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email")
        .when(t.rlike(r"(?i)^((https?|ftp)://|mailto:)\S+$"), "url")
        .when(t.rlike("^[+()0-9 .-]{7,25}$") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 7), "phone")
        .when(starts(COMMAND_STARTS), "command")
        .when(starts(CODE_STARTS) | (F.contains(t, F.lit("\n")) & (F.contains(t, F.lit("{")) | F.contains(t, F.lit("=>")))), "code")
        .otherwise("text")
    )


#: Fixed patterns of the input surfaces (P21), in order.
SURFACES = (
    ("recipient", r"^(?:to|cc|bcc|recipient|recipients|收件人|抄送|密送)(?:\b|$)"),
    ("address_bar", "address bar|location bar|地址栏|网址栏"),
    ("search", r"^(?:search|find|搜索|查找)(?:\b|$)"),
    ("shell_prompt", "shell prompt|terminal prompt|终端命令"),
    ("code_editor", "code editor|source editor|代码编辑"),
    ("chat_composer", "message composer|chat input|聊天输入|消息输入"),
    ("color", r"^(?:hex color|color value|颜色值|色值)$"),
    ("file_path", r"^(?:file path|folder path|文件路径|目录路径)$"),
)


def input_surface(label: Column, role: Column) -> Column:
    """The surface of a labelled field; text for plain text roles, else unknown."""
    out = F.when(role.isin("AXTextField", "AXTextArea", "AXComboBox"), "text").otherwise("unknown")
    for name, pattern in reversed(SURFACES):
        out = F.when(F.coalesce(label, F.lit("")).rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


# Application identifiers by category (P22): fixed values. A name that ends in a dot is a prefix; another stands for itself and what follows it after a dot.
APPLICATIONS = {
    "browser": ("com.apple.safari", "com.google.chrome", "org.mozilla.firefox", "com.microsoft.edgemac", "company.thebrowser.browser", "com.brave.browser", "com.operasoftware.opera", "com.vivaldi.vivaldi"),
    "development": ("com.apple.dt.xcode", "com.microsoft.vscode", "com.todesktop.230313mzl4w4u92", "dev.zed.zed", "com.jetbrains.", "com.sublimetext.", "com.panic.nova"),
    "terminal": ("com.apple.terminal", "com.googlecode.iterm2", "com.mitchellh.ghostty", "dev.warp.warp-stable", "org.alacritty", "net.kovidgoyal.kitty"),
    "mail": ("com.apple.mail", "com.microsoft.outlook", "com.readdle.smartemail-macos", "org.mozilla.thunderbird"),
    "messaging": ("com.apple.ichat", "com.apple.mobilesms", "com.tinyspeck.slackmacgap", "com.tencent.xinwechat", "com.tencent.qq", "com.hnc.discord", "ru.keepcoder.telegram",
                  "org.whispersystems.signal-desktop", "com.microsoft.teams2", "com.openai.chat", "com.anthropic.claudefordesktop"),
    "writing": ("com.apple.notes", "com.apple.textedit", "com.apple.iwork.pages", "com.microsoft.word", "md.obsidian", "notion.id", "net.shinyfrog.bear", "abnerworks.typora"),
    "spreadsheet": ("com.apple.iwork.numbers", "com.microsoft.excel"),
    "creative": ("com.figma.desktop", "com.bohemiancoding.sketch3", "com.adobe.photoshop", "com.adobe.illustrator", "com.seriflabs.", "org.blenderfoundation.blender"),
    "file_management": ("com.apple.finder", "com.binarynights.forklift", "com.cocoatech.pathfinder"),
}


def application_category(bundle: Column, groups: dict[str, tuple[str, ...]] = APPLICATIONS) -> Column:
    """The first category that lists the application's identifier; unknown if none does."""
    name, out = F.lower(bundle), F.lit("unknown")
    for category in reversed(list(groups)):
        exact = [x for x in groups[category] if not x.endswith(".")]
        fronts = [x if x.endswith(".") else f"{x}." for x in groups[category]]
        fits = name.isin(*exact) | F.exists(F.array(*map(F.lit, fronts)), lambda p: F.startswith(name, p))
        out = F.when(fits, category).otherwise(out)
    return out


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_substring(text: Column, start: Column, length: Column) -> Column:
    """A range of UTF-16 units; null where it splits a surrogate pair or leaves the text."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    at = lambda p: F.substring(units, p * 4 + 1, F.lit(4))
    low = lambda p: at(p).rlike("^D[C-F]")
    whole = (start >= 0) & (length >= 0) & (start + length <= utf16_length(text)) & ~low(start) & ~low(start + length)
    return F.when(whole, F.decode(F.unhex(F.substring(units, start * 4 + 1, length * 4)), "UTF-16BE"))


def request_failure(status: Column, body: Column) -> Column:
    """Reason of a failed request by its status and message."""
    m = F.lower(F.coalesce(body, F.lit("")))
    quota = (
        F.when(m.rlike("5-hour|5 hour|5h"), "quota_5h")
        .when(m.rlike("weekly|7-day|7 day"), "quota_weekly")
        .when(m.contains("month"), "quota_monthly")
        .when(m.contains("concurrent"), "account_concurrent_restriction")
        .when(m.rlike("quota|usage limit"), "quota_unknown_reset")
        .otherwise("permission_denied")
    )
    return (
        F.when(status == 403, quota)
        .when(status == 401, "authentication_or_model_entitlement")
        .when(status == 402, "membership_status")
        .when(status == 429, "short_term_rate_or_overload")
        .otherwise("transient_http_error")
    )


def failure_pause(reason: Column) -> Column:
    """Seconds to wait after a failure; null where waiting doesn't help."""
    hour = 3600
    out = F.when(reason.isin("short_term_rate_or_overload", "transient_http_error"), 0)
    for name, seconds in (("quota_5h", 5 * hour), ("quota_weekly", 7 * 24 * hour), ("quota_monthly", 31 * 24 * hour)):
        out = out.when(reason == name, seconds)
    return out


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date; never negative; null if it is neither."""
    date = F.try_to_timestamp(F.concat(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))
    seconds = F.coalesce(value.try_cast("double"), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


# Signals of a rate limit (P32), fixed values.
LIMIT_SIGNALS = ("provider_error_contains_429", "explicit_provider_free_model_rate_limit")
_EVENT = "struct<type:string,error:string,errorMessage:string,message:struct<role:string,stopReason:string,errorMessage:string>>"


def error_messages(stdout: Column) -> Column:
    """Messages of the error events in a log of JSON lines (P32): failed assistant messages, and error and retry events. Other text never counts."""
    events = F.transform(F.split(F.coalesce(stdout, F.lit("")), "\\r?\\n"), lambda x: F.from_json(x, _EVENT))
    said = lambda e: e["message"]
    failed = lambda e: F.coalesce((said(e)["role"] == "assistant") & said(e)["stopReason"].isin("error", "aborted"), F.lit(False))
    some = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs])
    text = lambda e: F.when(failed(e), some(said(e)["errorMessage"], said(e)["stopReason"])).when(e["type"].isin("error", "auto_retry_start", "auto_retry_end"), some(e["errorMessage"], e["error"]))
    return F.filter(F.transform(events, text), lambda m: m.isNotNull())


def limit_signal(text: Column) -> Column:
    """Whether an error text shows a rate limit: a bare 429, an explicit notice, or nothing."""
    t = F.lower(text)
    return F.when(t.rlike(r"\b429\b"), LIMIT_SIGNALS[0]).when(t.contains("reached free model rate limit"), LIMIT_SIGNALS[1])


def reset_countdown(text: Column) -> Column:
    """The longest announced reset within a week, in seconds."""
    t, pattern = F.lower(text), F.lit(r"\byour limit will reset in\s+(\d+)\s+(seconds?|minutes?|hours?)\b")
    both = F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("u"))
    seconds = F.transform(both, lambda x: x["n"].try_cast("long") * F.when(F.startswith(x["u"], F.lit("second")), 1).when(F.startswith(x["u"], F.lit("minute")), 60).otherwise(3600))
    return F.array_max(F.filter(seconds, lambda s: s <= 7 * 86400))


def limit_evidence(stdout: Column, stderr: Column) -> Column:
    """signal and countdown of a failed run's output; null without a signal."""
    text = F.concat(F.array_join(error_messages(stdout), "\n"), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    return F.when(limit_signal(text).isNotNull(), F.struct(limit_signal(text).alias("signal"), reset_countdown(text).alias("countdown")))


def word_count(text: Column) -> Column:
    """Words between white space: the additive token counter of the registered queries."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def known_usage(*counters: Column) -> Column:
    """True where some counter is known and not all are 0; all-zero usage is unknown."""
    return F.coalesce(F.greatest(*counters), F.lit(0)) > 0
