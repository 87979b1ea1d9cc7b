"""Publication dates as they stand in pages; the written local date is kept, no zone shifts it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portuguese month names.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def _month(name: Column, short: bool) -> Column:
    """Number of a month name as two digits, null for any other word."""
    out = None
    for i, m in enumerate(MONTHS, 1):
        hit = name.isin(m, m[:3]) if short else name == m
        out = F.when(hit, f"{i:02d}") if out is None else out.when(hit, f"{i:02d}")
    return out


def _date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def iso_or_portuguese(c: Column) -> Column:
    """``2025-07-24T..``, ``2026-05-05``, ``24 jul 2025 às 14h38`` or ``setembro 2, 2026``."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), _date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    words = F.split(F.trim(F.get(F.split(c, " às "), F.lit(0))), r"\s+")
    one, two, three = (F.regexp_replace(F.lower(F.get(words, F.lit(i))), ",$", "") for i in range(3))
    day_first = _date(F.concat_ws("-", F.when(three.rlike(r"^\d{4}$"), three), _month(two, True), F.when(one.rlike(r"^\d{1,2}$"), F.lpad(one, 2, "0"))), "yyyy-MM-dd")
    month_first = _date(F.concat_ws("-", F.when(three.rlike(r"^\d{4}$"), three), _month(one, True), F.when(two.rlike(r"^\d{1,2}$"), F.lpad(two, 2, "0"))), "yyyy-MM-dd")
    return F.coalesce(iso, F.when(F.size(words) == 3, F.coalesce(day_first, month_first)))


def dmy(c: Column) -> Column:
    """``03/05/2025 - 10:00``: the part before the dash."""
    part = F.trim(F.get(F.split(c, " - "), F.lit(0)))
    return F.when(part.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _date(part, "d/M/yyyy"))


def first_ten(c: Column) -> Column:
    """The first ten characters as dd/mm/yyyy."""
    part = F.substring(c, 1, 10)
    return F.when(part.rlike(r"^\d{2}/\d{2}/\d{4}$"), _date(part, "dd/MM/yyyy"))


def other_format(c: Column) -> Column:
    """``01/02/2026 às 09h30Atualizada ...`` or ``2 de março de 2026``."""
    part = F.trim(F.get(F.split(c, "Atualizada"), F.lit(0)))
    stamp = F.when(part.rlike(r"^\d{1,2}/\d{1,2}/\d{4} às \d{1,2}h\d{1,2}$"), _date(F.get(F.split(part, " "), F.lit(0)), "d/M/yyyy"))
    words = F.split(F.lower(part), " de ")
    day, month, year = (F.trim(F.get(words, F.lit(i))) for i in range(3))
    spelled = F.when((F.size(words) == 3) & day.rlike(r"^\d{1,2}$") & year.rlike(r"^\d{4}$"), _date(F.concat_ws("-", year, _month(month, False), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(stamp, spelled)


PARSERS = {"iso_or_portuguese": iso_or_portuguese, "dmy": dmy, "g1": first_ten, "other": other_format}


def dispatched(parser: Column, c: Column) -> Column:
    """The date by the parser that a portal names."""
    out = None
    for name, parse in PARSERS.items():
        out = F.when(parser == name, parse(c)) if out is None else out.when(parser == name, parse(c))
    return out


def first_parseable(parser: Column, candidates: list[Column]) -> Column:
    return F.coalesce(*[dispatched(parser, c) for c in candidates])


def is_recent(published: Column, today: Column, days: int = 7) -> Column:
    return F.datediff(today, published) <= days
