"""Request text for the external tick store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from stowline.fixed_values import KEY_FUNCTION, KEY_SLOT, KEY_SLOT_COUNT, KEY_TEMPLATE, REQUEST_TEMPLATE
from stowline.functions.times import request_date, request_time


def symbol_list(symbols: Column) -> Column:
    quoted = F.transform(symbols, lambda symbol: F.concat(F.lit('"'), symbol, F.lit('"')))
    return F.concat(F.lit("`$("), F.array_join(quoted, "; "), F.lit(")"))


def request_text(start: Column, end: Column, symbols: Column) -> Column:
    return F.format_string(
        REQUEST_TEMPLATE,
        request_date(start),
        request_time(start),
        request_date(end),
        request_time(end),
        symbol_list(symbols),
    )


def templated_request(start: Column, end: Column, symbols: Column, settings: Mapping[str, str]) -> Column:
    """Fill the settings' numbered slots by their declared type; longer slot names go first."""
    slots: dict[str, Column] = {}
    for number in range(int(settings[KEY_SLOT_COUNT])):
        key = f"{KEY_SLOT}{number}"
        kind = settings.get(f"{key}_TYPE", "").upper()
        if kind in ("SDATE", "STIME"):
            slots[key] = F.date_format(start, settings[f"{key}_FORMAT"])
        elif kind in ("EDATE", "ETIME"):
            slots[key] = F.date_format(end, settings[f"{key}_FORMAT"])
        elif kind == "STRING":
            slots[key] = symbol_list(symbols)
    text: Column = F.lit(settings[KEY_TEMPLATE])
    for key in sorted(slots, key=len, reverse=True):
        text = F.replace(text, F.lit(f"${key}"), slots[key])
    return F.concat(F.lit(settings.get(KEY_FUNCTION, "")), text)
