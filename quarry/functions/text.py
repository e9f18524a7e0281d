"""Text columns: e-mail addresses, phone numbers, roles, votes over vocabularies, restrictions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import FREE_PROVIDERS, RESTRICTIONS, ROLE_INBOXES, ROLE_RULES

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_AT, _DOT = r"(?:[(\[]\s*[Aa][Tt]\s*[\])]|AT)", r"(?:[(\[]\s*[Dd][Oo][Tt]\s*[\])]|DOT)"
_HIDDEN = rf"[A-Za-z0-9._%+-]+\s*{_AT}\s*[A-Za-z0-9.-]+\s*{_DOT}\s*[A-Za-z]{{2,}}"
_INVISIBLE = "[​‌‍﻿ ]"
_OUTER = " \t\r\n,:;!?\"'`()[]<>{}“”‘’"
PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}"


def normalize_email(raw: Column) -> Column:
    """The address in small letters without invisible characters, outer marks and white space; NULL if it is none."""
    outer = "[" + re.escape(_OUTER) + "]"
    x = F.lower(F.trim(F.regexp_replace(raw, _INVISIBLE, "")))
    x = F.regexp_replace(F.regexp_replace(x, f"^{outer}+", ""), f"(?:{outer}|\\.)+$", "")
    bad = r"^\.|\.$|\.\."

    def valid(x: Column) -> Column:
        return F.when(x.rlike(f"^{EMAIL}$") & ~F.regexp_extract(x, "^(.*)@", 1).rlike(bad) & ~F.regexp_extract(x, "@([^@]*)$", 1).rlike(bad), x)

    return F.get(F.transform(F.array(F.regexp_replace(x, r"\s+", "")), valid), F.lit(0))  # cleaned once, judged by its value


def emails_in(text: Column) -> Column:
    """Distinct addresses in order of first sight: plain ones, then `a [at] b [dot] c` decoded; plain words are never decoded."""

    def found(clean: Column) -> Column:
        # both patterns try every run of word characters: only texts with an @, or with an `at` and a `dot` mark, are searched
        plain = F.regexp_extract_all(F.when(clean.contains("@"), clean).otherwise(""), F.lit(f"({EMAIL})"), F.lit(1))
        marked = F.when(clean.rlike(_DOT) & clean.rlike(rf"{_AT}[\s\S]*{_DOT}"), clean).otherwise("")
        hidden = F.transform(F.regexp_extract_all(marked, F.lit(f"({_HIDDEN})"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, rf"\s*{_AT}\s*", "@"), rf"\s*{_DOT}\s*", "."))
        return F.array_distinct(F.filter(F.transform(F.concat(plain, hidden), normalize_email), lambda x: x.isNotNull()))

    return F.get(F.transform(F.array(F.regexp_replace(F.coalesce(text, F.lit("")), _INVISIBLE, "")), found), F.lit(0))


def mailto_addresses(values: Column) -> Column:
    """Distinct addresses of mailto values, what follows a question mark dropped."""
    found = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: normalize_email(F.split_part(v, F.lit("?"), F.lit(1))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def lenient_email(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"\s", "")


def email_quality(email: Column, domains: Column) -> Column:
    """Signals, tier and inbox kind of a normal address for an entity with these domains."""
    local, domain = F.split_part(email, F.lit("@"), F.lit(1)), F.split_part(email, F.lit("@"), F.lit(2))
    own = F.exists(F.coalesce(domains, F.array().cast("array<string>")), lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d)))
    free = domain.isin(FREE_PROVIDERS)
    role = local.isin(ROLE_INBOXES) | F.regexp_replace(local, "[0-9]+$", "").isin(ROLE_INBOXES)
    mark = lambda when, name: F.when(when, F.lit(name))
    signals = F.array_compact(F.array(F.lit("valid_format"), mark(own, "own_domain"), mark(~own, "domain_mismatch"), mark(~own & free, "free_provider"), mark(role, "role_inbox")))
    tier = F.when(own & role, "professional").when(own | role, "generic").when(free, "weak").otherwise("unclassified")
    kind = F.when(role, "role_based").otherwise("personal_or_other")
    return F.struct(signals.alias("signals"), tier.alias("tier"), kind.alias("inbox_kind"), domain.alias("domain"), own.alias("matches_station_domain"), free.alias("free_provider"))


def format_phone(raw: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(raw, r"\D", ""), r"^1(?=\d{10}$)", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3"))


def phones_in(text: Column) -> Column:
    """Distinct ten-digit numbers in order of first sight, as (AAA) BBB-CCCC."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PHONE})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, format_phone), lambda x: x.isNotNull() & ~x.rlike(r"^\([01]")))


def role_of(text: Column) -> Column:
    """The role of the first rule that finds its pattern, else `unknown`."""
    out = F
    for pattern, role in ROLE_RULES:
        out = out.when(text.rlike(f"(?i){pattern}"), role)
    return out.otherwise("unknown")


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Non-overlapping finds of each word, three of one word at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # texts without the word, nearly all, are told by one search
    each = [F.when(low.contains(w), F.least(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int"), F.lit(3))).otherwise(0) for w in words]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return total


def vote(text: Column, vocabulary: list[tuple[str, list[str]]], most: int, by_name: bool = True) -> Column:
    """Names with hits, most hits first; ties by name, or by place in the vocabulary."""
    scored = F.array(*[F.struct((-keyword_hits(text, words)).alias("h"), (F.lit(name) if by_name else F.lit(k)).alias("tie"), F.lit(name).alias("name")) for k, (name, words) in enumerate(vocabulary)])
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["h"] < 0)), 1, most), lambda s: s["name"])


def restrictions_in(text: Column) -> Column:
    """(restriction, evidence) of each pattern found, white space of the evidence collapsed."""
    found = [F.struct(F.lit(name).alias("restriction"), F.regexp_replace(F.regexp_extract(text, f"(?i)({p})", 1), r"\s+", " ").alias("evidence")) for name, p in RESTRICTIONS]
    return F.filter(F.array(*found), lambda s: s["evidence"] != "")


def clean_name(raw: Column) -> Column:
    """White space collapsed, marks at the end dropped; NULL if nothing is left."""
    x = F.trim(F.regexp_replace(F.regexp_replace(raw, "[   ]", " "), r"\s+", " "))
    return F.nullif(F.regexp_replace(x, r"[\s,;:|\-–—]+$", ""), F.lit(""))


def claim_value(kind: Column, raw: Column) -> Column:
    """The form in which two sightings of a value are compared; NULL drops the sighting."""
    x = F.lower(F.trim(raw))
    by_kind = F.when(kind == "email", normalize_email(raw)).when(kind == "url", F.split_part(F.regexp_replace(x, "/+$", ""), F.lit("#"), F.lit(1))).otherwise(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.trim(raw) != "", by_kind)


def short_slug(raw: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_")), 1, 24)


def instructions_in(text: Column) -> Column:
    """Up to five sentences with a submission cue, 400 characters in all; NULL for none."""
    cue = r"(?i)(submit|send|mail|email|attach|upload|post)\s+(?:your\s+)?(music|demos?|tracks?|songs?|cds?|mp3s?|press\s+kits?|bio)|(music|demo|track)\s+submissions?"
    found = F.transform(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(cue)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))
    step = lambda a, s: F.when(a["full"] | (a["n"] + F.length(s) + 1 > 400), F.struct(a["n"], a["kept"], F.lit(True).alias("full"))).otherwise(F.struct((a["n"] + F.length(s) + 1).alias("n"), F.concat(a["kept"], F.array(s)).alias("kept"), F.lit(False).alias("full")))
    return F.aggregate(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, 5), start, step, lambda a: F.nullif(F.array_join(a["kept"], "\n"), F.lit("")))
