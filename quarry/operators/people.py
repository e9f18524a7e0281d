"""People of pages: entries of staff lists, contacts of a page, their order, and drafts of messages to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import people as P
from ..functions.score import truthy
from ..functions.text import EMAIL, PHONE, emails_in, format_phone, mailto_addresses, normalize_email, phones_in, role_of
from ..functions.url import person_form
from .contacts import DECISION_ROLES, looked_up

# fixed values: a name and a role in one line
_PERSON = r"[A-Z][a-z]+(?:[- ][A-Z][a-z]+)*(?:\s+(?:de|van|von|del|da|di|le)\s+[A-Z][a-z]+(?:[- ][A-Za-z]+)*)*(?:\s+[A-Z][a-z]+(?:[- ][A-Za-z]+)*){0,3}"
NAME_THEN_ROLE = rf"^({_PERSON})\s*[,–—-]+\s*(.+)$"
ROLE_THEN_NAME = rf"^(.+?)\s*:\s+({_PERSON})$"
# fixed values: roles that keep a name without an address
KEPT_ROLES = [
    "music_director", "program_director", "music_programmer", "music_submission", "programming", "music_scheduler", "music_coordinator", "host", "dj",
    "station_manager", "general_manager",
]


def _lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, at, line, and what a line says) of the lines of pages (key, text): each line is read once."""
    df = pages.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    phone = F.regexp_extract("line", f"({PHONE})", 1)
    a, b = F.col("line").rlike(NAME_THEN_ROLE), F.col("line").contains(":") & F.col("line").rlike(ROLE_THEN_NAME)
    part = lambda pattern, group: F.regexp_extract("line", pattern, group)
    return df.select(
        key, "at", "line", P.is_person(F.col("line")).alias("named"), P.is_role_line(F.col("line")).alias("role_line"), normalize_email(F.nullif(F.regexp_extract("line", f"({EMAIL})", 1), F.lit(""))).alias("mail"),
        F.when(phone != "", F.when(format_phone(phone).rlike(r"^\([2-9]"), format_phone(phone)).otherwise(phone)).alias("tel"), F.when(a, part(NAME_THEN_ROLE, 1)).when(b, part(ROLE_THEN_NAME, 2)).alias("name"), F.when(a, part(NAME_THEN_ROLE, 2)).when(b, part(ROLE_THEN_NAME, 1)).alias("role"),
    )


def _nearby(window: list[Column]) -> tuple[Column, Column]:
    """The first address of these lines (mail, tel), and the first number from its line on."""
    mail = F.coalesce(*[w["mail"] for w in window])
    tel = F
    for k, w in enumerate(window):
        tel = tel.when(w["mail"].isNotNull(), F.coalesce(*[x["tel"] for x in window[k:]], F.lit(None).cast("string")))
    return mail, tel.otherwise(F.lit(None).cast("string"))


def staff_entries(pages: DataFrame, key: str) -> DataFrame:
    """(key, at, name, role, email, phone, percent) of the people that the text of staff pages (key, text) names, each name once.

    A line holds name and role, in either order; or a name, with role, address and number in the four lines below up to
    a blank one or the next name; or a role above a name.  Without an address only roles that matter for music or the
    station stay, and no number does.  A role above a name also serves an entry whose role is unknown.
    Lines of a page meet in one window over what was read of them; texts do not move.
    """
    w = Window.partitionBy(key).orderBy("at")
    what = F.struct("line", "named", "role_line", "mail", "tel")
    df = _lines(pages, key).withColumn("here", what)
    df = df.select("*", F.lag("here", 1).over(w).alias("before"), *[F.lead("here", k).over(w).alias(f"n{k}") for k in range(1, 6)])
    df = df.filter("name is not null or named")  # no other line begins an entry
    one_line = _nearby([F.col(c) for c in ("before", "here", "n1", "n2", "n3")])

    # below a name: its lines up to a blank one, a name, or a role that the next name has
    after = [F.struct(F.col(f"n{k}").alias("x"), F.coalesce(F.col(f"n{k + 1}")["named"], F.lit(False)).alias("then_name")) for k in range(1, 5)]
    none = F.lit(None).cast("string")

    def read(a: Column, y: Column) -> Column:
        x = y["x"]
        on = a["on"] & F.coalesce((x["line"] != "") & ~x["named"], F.lit(False)) & ~(a["role"].isNull() & F.coalesce(x["role_line"], F.lit(False)) & y["then_name"])
        mail = F.coalesce(a["mail"], F.when(on, x["mail"]))
        return F.struct(on.alias("on"), F.coalesce(a["role"], F.when(on & x["role_line"], x["line"])).alias("role"), mail.alias("mail"), F.coalesce(a["tel"], F.when(on & mail.isNotNull(), x["tel"])).alias("tel"))

    start = F.struct(F.lit(True).alias("on"), none.alias("role"), none.alias("mail"), none.alias("tel"))
    df = df.withColumn("below", F.aggregate(F.array(*after), start, read))
    role, below = F.col("below.role"), (F.col("below.mail"), F.col("below.tel"))

    entry = lambda name, role, near, when: F.when(when, F.struct(P.person_name(name).alias("name"), F.coalesce(role_of(role), F.lit("unknown")).alias("role"), near[0].alias("email"), near[1].alias("phone")))
    alone = F.col("name").isNull() & F.col("named")
    first = F.coalesce(entry(F.col("name"), F.col("role"), one_line, F.col("name").isNotNull()), entry(F.col("line"), role, below, alone))
    above = entry(F.col("line"), F.col("before.line"), one_line, F.coalesce(F.col("before.role_line"), F.lit(False)) & F.col("named"))
    rows = df.select(key, "at", F.explode(F.array(F.struct(F.lit(1).alias("way"), first.alias("e")), F.struct(F.lit(2).alias("way"), above.alias("e")))).alias("x"))
    rows = rows.select(key, "at", "x.way", "x.e.*").filter("name <> ''").withColumn("low", F.lower("name"))
    built = (F.col("email").isNotNull()) | F.col("role").isin(KEPT_ROLES)
    order = F.struct("way", "at")
    each = rows.groupBy(key, "low").agg(
        F.min_by(F.struct("at", "name", "role", "email", "phone"), F.when(built, order)).alias("e"), F.min_by("role", F.when((F.col("way") == 2) & (F.col("role") != "unknown"), F.col("at"))).alias("_above"),
    )
    out = each.filter("e is not null").select(key, "e.*", "_above")
    role = F.when(F.col("role") == "unknown", F.coalesce("_above", "role")).otherwise(F.col("role"))
    return out.select(key, "at", "name", role.alias("role"), "email", F.when(F.col("email").isNotNull(), F.col("phone")).alias("phone"), F.when(F.col("email").isNotNull(), 55).otherwise(30).alias("percent"))


def page_contacts(pages: DataFrame, key: str) -> DataFrame:
    """(key, contact, way, name, role, email, phone, percent): the contacts of pages (key, url, title, text, mailtos).

    Entries of a staff list; addresses in the text with the role nearest to them, which replace an entry of the same
    address; addresses of links that the text does not have, with the role of the whole text; names beside roles for
    contacts without one; and numbers, the first alone, where a page has no other contact.
    """
    none = F.lit(None).cast("string")
    df = pages.select(key, "url", "title", F.coalesce("text", F.lit("")).alias("text"), "mailtos").withColumn("lines", F.split("text", "\n"))
    staff = staff_entries(df.filter(P.is_directory(F.col("url"), F.col("title"), F.col("text")) & ~F.coalesce(person_form(F.col("url")), F.lit(False))).select(key, "text"), key)
    staff = staff.select(key, F.coalesce("email", F.concat(F.lit("name:"), F.lower("name"))).alias("contact"), F.lit(2).alias("way"), F.col("at").alias("place"), "name", "role", "email", "phone", "percent")

    # addresses of the text and of links, and the first number, as rows of one scan
    none_yet = F.array().cast("array<struct<way:int,place:int,value:string>>")
    at = lambda way: lambda value, k: F.struct(F.lit(way).alias("way"), k.alias("place"), value.alias("value"))
    tel = F.get(phones_in(F.col("text")), F.lit(0))
    values = F.concat(none_yet, F.transform(emails_in(F.col("text")), at(1)), F.coalesce(F.transform(mailto_addresses(F.col("mailtos")), at(3)), none_yet), F.when(tel.isNotNull(), F.array(at(4)(tel, F.lit(0)))).otherwise(none_yet))
    whole = F.when(F.size("mailtos") > 0, role_of(F.col("text")))
    found = df.select(key, "lines", whole.alias("_whole"), F.explode(values).alias("v")).select(key, "lines", "_whole", "v.*")
    line_at = F.get(F.filter(F.transform("lines", lambda x, k: F.when(F.contains(F.lower(x), F.col("value")), k)), lambda k: k.isNotNull()), F.lit(0))
    found = found.withColumn("line_at", F.when(F.col("way") != 3, line_at))
    near = F.when(F.col("line_at").isNotNull(), P.role_near(F.col("lines"), F.col("line_at"))["role"])
    is_tel = F.col("way") == 4
    found = found.select(
        key, F.when(is_tel, F.concat(F.lit("phone:"), "value")).otherwise(F.col("value")).alias("contact"), "way", "place", none.alias("name"), F.coalesce(F.when(F.col("way") == 3, F.col("_whole")).otherwise(near), F.lit("unknown")).alias("role"),
        F.when(~is_tel, F.col("value")).alias("email"), F.when(is_tel, F.col("value")).alias("phone"), looked_up(F.col("way"), {1: 30, 3: 25, 4: 20}, 0).alias("percent"),
    )

    every = found.unionByName(staff)
    rest = ["way", "place", "name", "role", "email", "phone", "percent"]
    listed = F.min(F.when(F.col("way") == 2, F.col("place"))).alias("_listed")  # an entry that is replaced keeps its place
    one = every.groupBy(key, "contact").agg(F.min(F.struct(*rest)).alias("x"), listed).select(key, "contact", "_listed", "x.*")
    first = one.withColumn("_best", F.min("way").over(Window.partitionBy(key))).filter("way < 4 or _best = 4").drop("_best")
    names = df.select(key, F.posexplode(P.names_in(F.col("text"))).alias("_place", "_x")).select(key, "_place", F.col("_x.name").alias("name"), F.col("_x.role").alias("role"))
    # the first contacts without a name get the first names of their role; rows are read once, those with a name meet none
    open_one = F.col("name").isNull()
    place = F.row_number().over(Window.partitionBy(key, "role", open_one).orderBy(F.col("_listed").asc_nulls_last(), "way", "place"))
    names = names.select(key, "role", F.col("name").alias("_name"), F.row_number().over(Window.partitionBy(key, "role").orderBy("_place")).alias("_n"))
    named = first.withColumn("_n", F.when(open_one, place)).join(names, [key, "role", "_n"], "left")
    return named.withColumn("name", F.coalesce("name", "_name")).select(*[c for c in first.columns if c not in ("place", "_listed")])


# fixed values: roles that come after those that decide on music
MORE_ROLES = ["host", "dj"]


def ranked_contacts(contacts: DataFrame, key: str, order: str) -> DataFrame:
    """contacts (role, preferred, email, confidence, ...) of each key with their place: by role, preferred ones, ones with an address, confidence."""
    grade = looked_up(F.lower(F.trim("role")), {r: k for k, r in enumerate([*DECISION_ROLES, *MORE_ROLES])}, 99)
    w = Window.partitionBy(key).orderBy(grade, F.desc(F.coalesce("preferred", F.lit(False))), F.desc(truthy(F.trim("email"))), F.desc(F.coalesce("confidence", F.lit(0))), order)
    return contacts.withColumn("place", F.row_number().over(w))


def draft(recipient: Column, track: Column, artist: Column) -> Column:
    """(greeting, subject, message) to a recipient (name, role, organization) about a track (title, listen_url, description) of an artist (name).

    Texts are trimmed; what is not known is left out, and a description is cut after 260 characters, by the rule.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    to, role, org = said(recipient["name"]), said(F.replace(recipient["role"], F.lit("_"), F.lit(" "))), said(recipient["organization"])
    title, link, about, by = said(track["title"]), said(track["listen_url"]), said(track["description"]), said(artist["name"])
    greeting = F.concat(F.lit("Hello"), F.coalesce(F.concat(F.lit(" "), to), F.lit("")), F.lit(","))
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    subject = F.concat(F.coalesce(F.concat(by, F.lit(" — "), quoted), quoted, by, F.lit("New music submission")), F.coalesce(F.concat(F.lit(" for "), org), F.lit("")))
    why = F.coalesce(F.concat(F.lit("I'm writing to the "), F.coalesce(role, F.lit("music team")), F.lit(" at "), org, F.lit(" to share a piece of music with the hope it fits what you feature.")), F.lit("I'm writing to share a piece of music with the hope it fits what you feature."))
    what = F.coalesce(F.concat(F.lit("the track "), quoted), F.concat(by, F.lit("'s music")), F.lit("a new track"))
    parts = [
        greeting, why, F.concat(F.lit("I'd love for you to hear "), what, F.lit(" and consider it for airplay.")), F.concat(F.lit("You can listen here:\n"), link),
        F.when(F.length(about) > 260, F.concat(F.substring(about, 1, 260), F.lit("…"))).otherwise(about), F.lit("Thank you for your time and for all you do for music."), F.concat(F.lit("Warm regards,\n"), by),
    ]
    return F.struct(greeting.alias("greeting"), subject.alias("subject"), F.concat_ws("\n\n", *parts).alias("message"))


def submission_path(paths: DataFrame) -> DataFrame:
    """paths (submission_url, submission_email, instructions, methods, restrictions, music_contact, send_page) with percent, reasons and the address promoted.

    Evidence adds up to 95 at most.  Where nothing else is known the page for sending music takes the place of the
    submission address; without one there is no path, and the row goes.
    """
    has_methods, has_rules = truthy(F.col("methods"), "array"), truthy(F.col("restrictions"), "array")
    url, mail, text = (F.col(c).isNotNull() for c in ("submission_url", "submission_email", "instructions"))
    steps = [
        (url, 35, F.lit("dedicated submission URL discovered")), (mail, 30, F.lit("submission email supported by page evidence")), (text, 15, F.lit("explicit submission instructions captured")),
        (has_methods, 10, F.concat(F.lit("submission method(s) inferred ("), F.array_join("methods", ", "), F.lit(")"))), (has_rules, 5, F.lit("submission restrictions documented")),
    ]
    bare = ~url & ~mail & ~text & ~F.coalesce("music_contact", F.lit(False))
    steps.append((bare & F.col("send_page").isNotNull(), 35, F.lit("published send-music page identified")))
    percent = F.lit(0)
    for when, points, _ in steps:
        percent = percent + F.when(when, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(when, why) for when, _, why in steps]))
    df = paths.withColumns({"percent": F.least(percent, F.lit(95)), "reasons": reasons, "_bare": bare})
    return df.withColumn("submission_url", F.coalesce("submission_url", F.when(F.col("_bare"), F.col("send_page")))).filter("not _bare or submission_url is not null").drop("_bare")
