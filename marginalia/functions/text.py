"""Text expressions: labels, masks, names, numbers, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what must not be in a release; domains and mounts of one's own are a parameter
SENSITIVE = (
    r"/Users/[^/\s]+",
    r"/root/",
    r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9]{25,}",
    r"AKIA[A-Z0-9]{16}",
)
DIGITS = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine")


def normal_label(x: Column) -> Column:
    """The trimmed label; null if it is empty or has white space inside."""
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when((x != "") & ~x.rlike(r"\s"), x)


def rival_index(view: Column) -> Column:
    """k of remove_off_k; null for other views."""
    return F.when(view.startswith("remove_off_"), F.regexp_extract(view, r"_([^_]*)$", 1).cast("bigint"))


def design_id(condition: Column) -> Column:
    """The part before the last _snr."""
    return F.regexp_replace(condition, r"^(.*)_snr.*$", "$1")


def bit_mask(x: Column, width: int = 3) -> Column:
    return F.lpad(F.bin(x), width, "0")


def title(x: Column) -> Column:
    """First letter large, unless the text is in capitals already (and has a letter)."""
    return F.when((F.upper(x) == x) & (F.lower(x) != x), x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000)))


def macro_name(x: Column) -> Column:
    """CamelCase of the parts, digits as words."""
    name = F.regexp_replace(F.initcap(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")), " ", "")
    for i, word in enumerate(DIGITS):
        name = F.replace(name, F.lit(str(i)), F.lit(word))
    return name


def fixed(x: Column, digits: int) -> Column:
    """Half-even on the binary value, without thousands' marks and without a negative zero."""
    text = F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    zero = F.format_string("%." + str(digits) + "f", F.lit(0.0))
    return F.when(text == F.concat(F.lit("-"), zero), zero).otherwise(text)


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def signed(x: Column, digits: int = 1) -> Column:
    return F.when(fixed(x, digits).startswith("-"), fixed(x, digits)).otherwise(F.concat(F.lit("+"), fixed(x, digits)))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def own_places(domains: tuple[str, ...] = (), mounts: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Patterns of hosts in domains and of folders below mounts."""
    return (*(r"[\w.-]+\." + re.escape(d) for d in domains), *(re.escape(m.rstrip("/")) + r"/[^/\s]+" for m in mounts))


def sensitive(x: Column, extra: tuple[str, ...] = ()) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in (*SENSITIVE, *extra)))
