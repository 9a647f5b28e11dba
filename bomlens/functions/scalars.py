"""Scalar rules of the domain as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component types that count as cryptographic, kinds of assets, statuses in their order with sign and label.
CRYPTO_TYPES = ["cryptographic-asset", "cryptographic asset", "crypto-assets", "crypto asset", "crypto-asset", "crypto assets"]
ASSET_TYPES = ["algorithm", "key", "certificate", "digest", "related-crypto-material"]
STATUSES = {"completed": ("✅", "Completed"), "failed": ("💥", "Failed"), "timeout": ("⏰", "Timeout"), "cancelled": ("🚫", "Cancelled"), "pending": ("💤", "Pending")}
# Languages that the static analyser knows, by their usual names.
ANALYSER_LANGUAGES = {"python": "python", "java": "java", "javascript": "javascript", "typescript": "javascript", "c": "cpp", "c++": "cpp", "cpp": "cpp", "c#": "csharp", "csharp": "csharp", "go": "go", "ruby": "ruby", "swift": "swift", "kotlin": "kotlin"}
# What a clone error's text says, and the reason it stands for.
CLONE_REASONS = [(("repository not found",), "private or not found"), (("authentication failed", "could not read username"), "private repo (auth required)"), (("ssl certificate", "certificate verify failed"), "ssl certificate error"), (("could not resolve host", "timed out"), "network error")]
# Runtimes in seconds below which a label holds, from one minute on.
RUNTIME_BANDS = [(120, "1-2 minutes"), (300, "2-5 minutes"), (600, "5-10 minutes"), (1200, "10-20 minutes"), (1800, "20-30 minutes"), (3600, "30-60 minutes"), (7200, "1-2 hours"), (14400, "2-4 hours")]


def missing_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[missing_as_null(c) for c in cs])


def is_crypto_type(c: Column) -> Column:
    """A null type is none."""
    return F.coalesce(F.lower(F.trim(c)).isin(CRYPTO_TYPES), F.lit(False))


def type_label(c: Column) -> Column:
    """F01."""
    return F.coalesce(missing_as_null(c), F.lit("unknown"))


def asset_label(asset: Column, primitive: Column) -> Column:
    """the asset type, with the primitive in brackets if there is one."""
    asset = F.coalesce(asset, F.lit(""))
    return F.when(F.trim(F.coalesce(primitive, F.lit(""))) == "", asset).otherwise(F.concat(asset, F.lit(" ("), primitive, F.lit(")")))


def name_before_at(c: Column) -> Column:
    """F03."""
    return F.substring_index(F.coalesce(c, F.lit("")), "@", 1)


def int_or_zero(c: Column) -> Column:
    """whole numbers only."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0))


def int_or(c: Column, default: int = 0) -> Column:
    """whole numbers, else numbers cut to whole ones, else the default."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def runtime_band(seconds: Column) -> Column:
    """a coarse label for a runtime; five-second bands below a minute."""
    upper = (F.floor((seconds + 4) / 5) * 5).cast("int")
    out = F.when(seconds.isNull() | F.isnan(seconds), "unknown").when(seconds <= 5, "<5 seconds")
    out = out.when(seconds < 60, F.concat(F.greatest(F.lit(5), upper - 5).cast("string"), F.lit("-"), upper.cast("string"), F.lit(" seconds")))
    for limit, label in RUNTIME_BANDS:
        out = out.when(seconds < limit, label)
    return out.otherwise(">4 hours")


def pair_count(total: Column, squares: Column) -> Column:
    """Pairs across tools from the sum of counts and the sum of their squares."""
    return (total * total - squares) / 2


def matching_seconds(total: Column, pairs: Column) -> Column:
    """F07."""
    return F.when(total <= 0, 0.0).otherwise(1.5 + 0.01 * total + 0.00002 * pairs)


def human_duration(seconds: Column) -> Column:
    """F08."""
    s = F.coalesce(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("long")
    d, h = F.floor(whole / 86400).cast("long"), F.floor(whole % 86400 / 3600).cast("long")
    m, r = F.floor(whole % 3600 / 60).cast("long"), whole % 60
    return (
        F.when(s <= 0, "0s")
        .when(s < 1, F.concat(F.bround(s * 1000).cast("int").cast("string"), F.lit("ms")))
        .when(d > 0, F.format_string("%dd %dh %dm %02ds", d, h, m, r))
        .when(h > 0, F.format_string("%dh %dm %02ds", h, m, r))
        .when(m > 0, F.format_string("%dm %02ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def duration_and_size(seconds: Column, size_bytes: Column) -> Column:
    """absent parts are left out."""
    size = F.when(size_bytes >= 0, F.format_string("%.1f KB", F.bround(size_bytes / 1024.0, 1)))
    return F.concat_ws(" · ", F.when(seconds.isNotNull(), F.format_string("%.1fs", F.bround(seconds, 1))), size)


def payload_status(status: Column) -> Column:
    """what a worker reported, as a status."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s == "ok", "completed").when(s.isin("timeout", "cancelled"), s).when(s != "", "failed").otherwise("pending")


def job_status(status: Column, payload: Column) -> Column:
    """a job's status in the grid; a failure that the payload calls a timeout is one."""
    return (
        F.when(status == "completed", "completed")
        .when(status == "failed", F.when(F.lower(payload) == "timeout", "timeout").otherwise("failed"))
        .when(status == "cancelled", "cancelled")
        .otherwise("pending")
    )


def status_text(status: Column, mode: str = "both") -> Column:
    """sign, label or both; nothing for unknown statuses."""
    pick = {"emoji": lambda v: v[0], "label": lambda v: v[1], "both": lambda v: f"{v[0]} {v[1]}"}[mode]
    out = F.lit("")
    for key, value in STATUSES.items():
        out = F.when(status == key, pick(value)).otherwise(out)
    return out


def result_cell(status: Column, payload: Column, seconds: Column, size_bytes: Column) -> Column:
    """a job's cell in a result grid."""
    s = F.trim(F.lower(F.coalesce(status, F.lit(""))))
    return (
        F.when(s == "fired", STATUSES["pending"][0])
        .when(s == "completed", F.trim(F.concat(F.lit(STATUSES["completed"][0] + " "), duration_and_size(seconds, size_bytes))))
        .when(s == "cancelled", " ".join(STATUSES["cancelled"]))
        .otherwise(status_text(payload_status(payload)))
    )


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def repo_info(language: Column, stars: Column, size_kb: Column) -> Column:
    """language, stars and size; zero and missing parts are left out."""
    text = F.concat_ws(" · ", F.concat(F.lit("💬 "), missing_as_null(language)), F.when(stars > 0, F.concat(F.lit("⭐"), thousands(stars))), F.when(size_kb > 0, F.concat(F.lit("💾"), thousands(size_kb), F.lit(" KB"))))
    return F.when(text == "", "—").otherwise(text)


def repo_url(html_url: Column, full_name: Column) -> Column:
    """F15."""
    name = F.trim(F.coalesce(full_name, F.lit("")))
    return F.coalesce(missing_as_null(html_url), F.when(name != "", F.concat(F.lit("https://github.com/"), name)), F.lit(""))


def inspection_header(name: Column, insp_id: Column, created: Column, jobs: Column) -> Column:
    """F18."""
    q = F.lit("?")
    return F.concat(F.lit("**"), name, F.lit("**<br/><span style='opacity:0.75; font-size:0.9rem;'><b>ID:</b> "), insp_id, F.lit("<br/><b>Created:</b> "), first_present(created, q), F.lit("  ·  <b>Jobs:</b> "), first_present(jobs, q), F.lit("</span>"))


def owner_and_repo(line: Column) -> Column:
    """A line is a URL, whose last two path segments count, or the name itself. ``.git`` stays."""
    line = F.trim(line)
    parts = F.split(F.regexp_replace(line, r"/+$", ""), "/")
    return F.when(line.startswith("http"), F.array_join(F.slice(parts, -2, 2), "/")).otherwise(line)


def host_path(url: Column) -> Column:
    """host and path of http, https and git@ addresses, without a final .git."""
    u = F.regexp_replace(F.trim(url), r"\.git$", "")
    web = F.regexp_replace(F.regexp_replace(u, r"^https?://", ""), r"[?#].*$", "")
    ssh = F.regexp_replace(F.regexp_replace(u, r"^git@", ""), "^([^:]*):", "$1/")
    return F.regexp_replace(F.when(u.rlike("^https?://"), web).when(u.startswith("git@"), ssh).otherwise(u), r"^/+|/+$", "")


def redacted(url: Column) -> Column:
    """credentials in a URL are dropped."""
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***@")


def analyser_language(c: Column) -> Column:
    """null for languages that the analyser doesn't know."""
    known = F.create_map(*[F.lit(x) for kv in ANALYSER_LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(F.coalesce(c, F.lit("")))))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """edits over the longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def rename_cost(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    """nodes of different kinds are never renamed; equal labels cost nothing."""
    return F.when(kind_a != kind_b, 1e9).when(a == b, 0.0).otherwise(0.5 + normalized_levenshtein(a, b))


def harmonized(c: Column) -> Column:
    """J08 on a string: lower case, nothing from the first @ of a line on, letters a-z and digits alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "@.*", ""), "[^a-z0-9]", "")


def trace_text(*lines: Column) -> Column:
    """F28."""
    return F.concat_ws("\n", *[missing_as_null(c) for c in lines])


def clone_reason(text: Column) -> Column:
    """why a clone failed, by its error text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("unknown")
    for needles, reason in reversed(CLONE_REASONS):
        out = F.when(reduce(lambda x, y: x | y, [low.contains(n) for n in needles]), reason).otherwise(out)
    return out


def hash_bucket(c: Column, buckets: int) -> Column:
    """the md5 of a text as a number modulo ``buckets``, exact over all 128 bits: digit by digit in base 2**28."""
    h = F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    out = F.lit(0).cast("bigint")
    for at, n in ((1, 7), (8, 7), (15, 7), (22, 7), (29, 4)):
        out = (out * (16**n) + F.conv(F.substring(h, at, n), 16, 10).cast("bigint")) % buckets
    return out


def parsed_list(c: Column) -> Column:
    """Items between commas and white space, each once, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,]+"), lambda x: x != ""))


def newest_first(*stamps: Column) -> Column:
    """A sort key; what can't be read comes last."""
    return F.coalesce(*[c.try_cast("timestamp") for c in stamps]).desc_nulls_last()


def letter_histogram(c: Column) -> Column:
    """How often each letter a-z occurs."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: (F.length(low) - F.length(F.replace(low, F.char(i)))).cast("int"))


def days_ago(days: Column, now: Column) -> Column:
    """the date so many days before ``now``, in UTC."""
    return F.date_format(F.date_sub(now.cast("date"), days), "yyyy-MM-dd")
