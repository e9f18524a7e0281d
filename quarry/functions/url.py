"""URL columns: normal form, host, registrable domain, and what a path says about its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import LINK_WEIGHTS, RESERVED_SUFFIXES, TRACKING_PARAMS, TWO_LABEL_SUFFIXES

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"


def _with_scheme(url: Column) -> Column:
    x = F.trim(url)
    return F.when(x.rlike(_SCHEME), x).otherwise(F.concat(F.lit("https://"), x))


def path(url: Column) -> Column:
    return F.regexp_extract(_with_scheme(url), r"^[^:]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_with_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def _authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_with_scheme(url), r"^[^:]+://(?:[^/?#]*@)?([^/?#@]*)", 1))


def normalize_url(url: Column) -> Column:
    """Scheme and host lowered, `www.`, fragment and tracking parameters dropped, the rest sorted, no slash at the end.

    NULL for what is not http(s) or has no host with a dot.  A path of slashes alone stays one slash.
    """
    full, authority = _with_scheme(url), _authority(url)
    scheme = F.lower(F.regexp_extract(full, _SCHEME, 1))
    host = F.regexp_replace(authority, r":\d*$", "")
    shown = F.regexp_replace(F.regexp_replace(authority, r"^www\.", ""), r":$", "")
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING_PARAMS))
    tail = F.array_join(F.array_sort(kept), "&")
    short = F.when(F.length(path(url)) > 1, F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path(url))
    out = F.concat(scheme, F.lit("://"), shown, short, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))
    return F.when((F.trim(url) != "") & scheme.isin("http", "https") & (host != "") & (host.contains(".") | (host == "localhost")), out)


def canonical_host(url: Column) -> Column:
    """Host in small letters without user, port and `www.`; a bare host is taken as it is."""
    x = F.lower(F.trim(url))
    rest = F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, r":.*$", ""), r"^www\.", "")


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, or three where the last two are a public suffix."""
    host = canonical_host(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(n < 2, host).when((n >= 3) & last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def page_role(url: Column) -> Column:
    """contact_page, submission_page or programming_page by a word anywhere in the address, else NULL."""
    x = F.lower(url)
    return F.when(x.contains("contact"), "contact_page").when(x.rlike("submi(ssion|t)"), "submission_page").when(x.rlike("program|shows|schedule"), "programming_page")


def source_type(url: Column) -> Column:
    x = F.lower(F.coalesce(url, F.lit("")))
    return F.when(x.contains("submi"), "submission_page").when(x.contains("contact"), "contact_page").otherwise("official_website_page")


def link_weight(url: Column, anchor: Column) -> Column:
    """The largest weight of a pattern found in address or anchor, 0 for none."""
    x = F.concat_ws(" ", url, F.coalesce(anchor, F.lit("")))
    return F.greatest(*[F.when(x.rlike(f"(?i){p}"), w).otherwise(0) for p, w in LINK_WEIGHTS])


def reserved_host(url: Column) -> Column:
    """The host ends in a suffix reserved for tests."""
    return F.coalesce(canonical_host(url).rlike(rf"(^|\.)({'|'.join(RESERVED_SUFFIXES)})$"), F.lit(False))


def same_document(a: Column, b: Column) -> Column:
    """Scheme, host and path are equal; query and fragment may differ."""
    bare = lambda x: F.regexp_replace(_with_scheme(x), r"[?#].*$", "")
    return F.lower(bare(a)) == F.lower(bare(b))


def item_page(url: Column) -> Column:
    """The path names a single item: a long id, a bare number, a date or a UUID."""
    return path(url).rlike(r"\d{5,}|/\d{4,}(/|$)|/\d{4}/\d{1,2}(/\d{1,2})?(/|$)|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def media_or_feed(url: Column) -> Column:
    """The path ends in an extension of media, archives or feeds."""
    return F.lower(path(url)).rlike(r"\.(mp3|m4a|wav|ogg|flac|aac|m3u8?|pls|mp4|mov|avi|webm|jpe?g|png|gif|svg|webp|ico|css|js|json|xml|rss|atom|zip|gz|rar|pdf)$")


# fixed values: what addresses of a person's form, of log-in pages, of players and of people look like
PERSON_PARAMS = ["id", "uid", "user", "userid", "user_id", "to", "from", "person", "profile", "member", "contactid"]
PERSON_FORM = r"(?:\bemail\b|\bmails\b|\bmailto\b|\bmessage\b|\bsend\b)"
AUTH_PATH = r"(?:^|/)(?:auth|login|log[-_]?in|logout|log[-_]?out|register|sign[-_]?in|sign[-_]?up|signup|fav_?icon|cdn-cgi|email-protection)(?:/|$|\.)"
AUTH_QUERY = r"(?:^|[?&])a=|fav_?icon|type=(?:program|episode|channel|homepage)"
PLAYER_PATH = r"(?:flashplayer|streambox|mediaplayer|audioplayer)"
PLAYER_PARAMS = ["show", "archive", "episode", "player", "stream", "program", "track", "song", "audio", "video", "clip"]
PEOPLE_PATH = r"/(?:djs|dj|hosts|host|presenters|presenter|people|person|personality|onair|on-air|staff|staff-directory|team|author|contributors|reporters)(?:s)?/"
# fixed values: categories of pages in order, by label and address
PAGE_CATEGORIES = [
    ("send_music", r"send[\s\-_]?us[\s\-_]?(your)?[\s\-_]?music|send[\s\-_]?(your|us)[\s\-_]?music|submit[\s\-_]?(your)?[\s\-_]?music|music[\s\-_]?submissions?|give[\s\-_]?us[\s\-_]?(your)?[\s\-_]?music|promo"),
    ("submission_guidelines", r"submission[\s\-_]?guidelines|how[\s\-_]?to[\s\-_]?submit|(guidelines|requirements)\b"),
    ("dj_directory", r"\bdjs?\b|dj(?:s|'s)?\b|disc[\s\-]?jockeys?\b|deejays?\b|air[\s\-]?staff\b|on[\s\-]?air[\s\-]?(personalities|staff|hosts)\b|\bhosts?\b|\bdjs?(?:[\s\-]?(and|&)[\s\-]?staff)?(\s+(directory|pages|email|list))?"),
    ("contact", r"contact[\s\-_]?(us)?\b|get[\s\-_]?in[\s\-_]?touch\b|email[\s\-_]?us\b|mail[\s\-_]?us\b|reach[\s\-_]?(us|out)\b|\bdirectory\b|staff(?:[\s\-_]?directory)?\b|\bpeople\b|\bteam\b"),
    ("programming", r"programming\b|program[\s\-_]?director\b|\bshows?\b|\bschedule\b"),
    ("about", r"\babout([\s\-_]?us)?\b$"),
]
CATEGORY_ORDER = ["send_music", "submission_guidelines", "dj_directory", "programming", "contact", "about", "other"]


def _has_param(url: Column, names: list[str]) -> Column:
    return F.lower(query(url)).rlike(f"(?:{'|'.join(names)})=")


def person_form(url: Column) -> Column:
    """A form that writes to one person: a path of mail and a parameter that names someone."""
    return F.lower(path(url)).rlike(PERSON_FORM) & _has_param(url, PERSON_PARAMS)


def auth_or_chrome(url: Column) -> Column:
    """Log-in pages, icons and helpers."""
    return F.lower(path(url)).rlike(AUTH_PATH) | F.lower(query(url)).rlike(AUTH_QUERY)


def player_page(url: Column) -> Column:
    """A player of one item, by path or parameter."""
    return F.lower(path(url)).rlike(PLAYER_PATH) | _has_param(url, PLAYER_PARAMS)


def person_profile(url: Column) -> Column:
    """Something stands behind a path of people."""
    x = F.concat(F.lit("/"), F.regexp_replace(path(url), "^/+", ""))
    return F.regexp_extract(x, f"(?i){PEOPLE_PATH}/*(.*)$", 1) != ""


def page_category(label: Column, url: Column) -> Column:
    """The first category whose pattern the label or the address has, else `other`."""
    text = F.lower(F.trim(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(url, F.lit("")))))
    out = F
    for name, pattern in PAGE_CATEGORIES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def page_address(url: Column) -> Column:
    """Scheme, host with port, and path without slash at the end; no query."""
    scheme = F.lower(F.regexp_extract(_with_scheme(url), _SCHEME, 1))
    return F.concat(scheme, F.lit("://"), _authority(url), F.regexp_replace(path(url), "/+$", ""))


def quoted(text: Column) -> Column:
    """Percent-encoded, for links that open a message."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def booking_link(links: Column) -> Column:
    """The first link whose path speaks of booking; NULL for none."""
    return F.get(F.filter(links, lambda x: F.lower(path(x)).rlike("book|gig|hire[-_]?a[-_]?dj|press[-_]?kit")), 0)
