"""Columns on uploads and on addresses to check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_UPLOAD, LONGEST_NAME, DEFAULT_NAME = 20 * 1024 * 1024, 200, "upload.mp3"

# fixed values: addresses of profiles by platform
SOCIAL = [
    ("facebook", r"(?i)(https?://(?:www\.|[a-z]{2}-[a-z]{2}\.)?facebook\.com/[A-Za-z0-9_.\-]+)"),
    ("instagram", r"(?i)(https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.\-]+)"),
    ("x", r"(?i)(https?://(?:www\.)?(?:x|twitter)\.com/[A-Za-z0-9_]{1,15})"),
    ("youtube", r"(?i)(https?://(?:www\.)?youtube\.com/(?:@|c/|channel/|user/)[A-Za-z0-9_.\-]+)"),
    ("linkedin", r"(?i)(https?://(?:[a-z]{2}\.)?(?:www\.)?linkedin\.com/(?:company|in)/[A-Za-z0-9_.\-]+)"),
]


def track_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def is_mp3(content: Column) -> Column:
    """An ID3 tag, or an MPEG frame: eleven sync bits, a version, a layer and a bit rate that are not reserved."""
    head = F.hex(F.substring(content, 1, 4))
    bits = F.lpad(F.conv(head, 16, 2), 32, "0")
    field = lambda at, n: F.substring(bits, at, n)
    frame = (field(1, 11) == "1" * 11) & (field(12, 2) != "01") & (field(14, 2) != "00") & ~field(17, 4).isin("0000", "1111")
    return F.coalesce((F.length(content) >= 4) & (head.startswith("494433") | frame), F.lit(False))


def upload_verdict(content: Column, most: int = LARGEST_UPLOAD) -> Column:
    """(accepted, reason) of an upload."""
    n = F.coalesce(F.octet_length(content), F.lit(0))
    reason = F.when(n == 0, "empty upload").when(n > most, f"payload exceeds {most} bytes").when(~is_mp3(content), "not an MP3 stream")
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"))


def safe_filename(name: Column) -> Column:
    """The last part of a path without control characters and outer dots, at most 200 characters with its suffix kept."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", ""), r"[\x00-\x1f\x7f]", "")
    x = F.regexp_replace(F.regexp_replace(F.trim(x), r"^\.+|\.+$", ""), r"\s+", " ")
    suffix = F.regexp_extract(x, r"(\.[^.]{1,10})$", 1)
    short = F.concat(F.substring(x, F.lit(1), F.lit(LONGEST_NAME) - F.length(suffix)), suffix)
    return F.when(x == "", DEFAULT_NAME).when(F.length(x) > LONGEST_NAME, short).otherwise(x)


def social_urls(links: Column) -> Column:
    """The first profile address of each platform among links."""
    def first(pattern: str) -> Column:
        return F.get(F.filter(F.transform(links, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), F.lit(0))

    found = [F.struct(F.lit(name).alias("key"), first(pattern).alias("value")) for name, pattern in SOCIAL]
    return F.map_from_entries(F.filter(F.array(*found), lambda s: s["value"].isNotNull()))


def social_handle(value: Column) -> Column:
    """host/first part of an address, @name of a handle, NULL for nothing: one person's profile reads alike in all forms."""
    x = F.regexp_replace(F.lower(F.trim(value)), "/+$", "")
    host = F.regexp_replace(F.regexp_extract(x, r"^https?://([^/?#]*)", 1), r"^www\.", "")
    first = F.nullif(F.regexp_extract(x, r"^https?://[^/?#]*/+([^/?#]*)", 1), F.lit(""))
    name = F.nullif(F.trim(F.regexp_replace(x, "^[@#]+", "")), F.lit(""))
    return F.when(x.rlike("^https?://"), F.concat_ws("/", host, first)).otherwise(F.concat(F.lit("@"), name))


def check_targets(submission_url: Column, instructions_url: Column) -> Column:
    """Distinct (url, kind) of http(s) addresses to check."""
    both = F.array(F.struct(F.trim(submission_url).alias("url"), F.lit("submission_url").alias("kind")), F.struct(F.trim(instructions_url).alias("url"), F.lit("instructions_page").alias("kind")))
    return F.array_distinct(F.filter(both, lambda s: F.coalesce(s["url"].rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))))
