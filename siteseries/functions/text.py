"""Text helpers for names and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteseries.functions.numeric import col


def title_label(c: Column | str) -> Column:
    """Underscores to spaces, words capitalised."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def title_name(name: str, acronyms: dict[str, str] | None = None) -> str:
    """Column-name form of `title_label`, with replacements for acronyms."""
    out = " ".join(w[:1].upper() + w[1:].lower() for w in name.replace("_", " ").split(" "))
    for short, full in (acronyms or {}).items():
        out = re.sub(rf"\b{re.escape(short)}\b", full, out)
    return out


def snake_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace(".", "_")


def repair_taxon(c: Column | str, repairs: dict[str, str] | None = None) -> Column:
    """Collapse runs of dots or blanks in a taxon name, then apply literal repairs."""
    out = F.trim(F.regexp_replace(col(c), r"[\s.]+", " "))
    for wrong, right in (repairs or {}).items():
        out = F.regexp_replace(out, f"^{re.escape(wrong)}$", right)
    return out
