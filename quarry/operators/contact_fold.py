"""Contacts of a station from stored rows and from pages, matched in two stages.

A contact joins the one that has its address, or else the one of its name and role, and brings what that lacks: name,
telephone, address, provenance.  What joins neither is a contact of its own.  The order of rows decides, as an address
that a contact gains is one by which later rows find it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "station string, place int, name string, role string, email string, phone string, source_url string, provenance array<string>, rows long"


class _Station:
    """The contacts of one station; memory follows them, not the rows."""

    def __init__(self):
        self.contacts: list[dict] = []
        self.by_email: dict[str, dict] = {}
        self.by_person: dict[tuple[str, str], dict] = {}

    def _new(self, name, role, email, phone, url, provenance) -> None:
        contact = {"name": name, "role": role, "email": email, "phone": phone, "source_url": url, "provenance": dict.fromkeys(provenance), "rows": 1}
        self.contacts.append(contact)
        if email:
            self.by_email[email] = contact
        if name:
            self.by_person[name.strip().lower(), role] = contact

    def add(self, stored, name, role, email, phone, url, provenance) -> None:
        role = role or "unknown"
        if stored:
            self._new(name, role, email, phone, url, provenance)
            return
        found = self.by_email.get(email) if email else None
        if found is None and name and name.strip():
            found = self.by_person.get((name.strip().lower(), role))
        if found is None:
            self._new(name, role, email, phone, url, provenance)
            return
        found["rows"] += 1
        found["provenance"] |= dict.fromkeys(p for p in provenance if p not in found["provenance"])
        found["name"] = name if found["name"] is None and name else found["name"]
        found["phone"] = phone if found["phone"] is None and phone else found["phone"]
        if email and not found["email"]:
            found["email"] = email
            self.by_email[email] = found

    def frame(self, station) -> pd.DataFrame:
        rows = [(station, k, c["name"], c["role"], c["email"], c["phone"], c["source_url"], list(c["provenance"]), c["rows"]) for k, c in enumerate(self.contacts)]
        return pd.DataFrame(rows, columns=["station", "place", "name", "role", "email", "phone", "source_url", "provenance", "rows"])


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, None
    for part in parts:
        for station, stored, name, role, email, phone, url, provenance in part.itertuples(index=False, name=None):
            if state is None or station != now:
                if state is not None:
                    yield state.frame(now)
                now, state = station, _Station()
            state.add(stored, name, role, email, phone, url, provenance if provenance is not None else [])
    if state is not None:
        yield state.frame(now)


def matched_contacts(rows: DataFrame) -> DataFrame:
    """(station, place, name, role, email, phone, source_url, provenance, rows) from rows (station, stored, ord, name, role, email, phone, source_url, provenance).

    Stored rows come first, then the others in the order of ord, which must be a total one in a station; place counts from
    0 in order of first sight, rows are those that a contact was made of.  Rows of no station are left out, a null role is
    `unknown`.  The rows of a station stream through one task, which holds its contacts.
    """
    df = rows.select("station", F.coalesce("stored", F.lit(False)).alias("stored"), "ord", "name", "role", "email", "phone", "source_url", "provenance").filter("station IS NOT NULL").withColumn("station", F.col("station").cast("string"))
    dealt = df.repartition("station").sortWithinPartitions("station", F.desc("stored"), "ord").drop("ord")
    return dealt.mapInPandas(_matched, _OUT)
