"""Text cleaning, tokens, content identity, and text assembly."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes that do not count, from the last token on.
COMPANY_SUFFIXES = (
    "inc incorporated llc llp ltd limited pvt private plc corp corporation co gmbh ag sa srl bv group holdings "
    "technologies technology labs software systems solutions india global worldwide"
).split()
#: Location tokens with another name.
LOCATION_ALIASES = {"bangalore": "bengaluru", "blr": "bengaluru", "anywhere": "remote", "worldwide": "remote", "wfh": "remote", "distributed": "remote"}
ZERO_WIDTH = "​‌‍﻿"
#: Words that say nothing about a posting.
STOPWORDS = (
    "the and for with you our are will have who this that your their from was were has had not but all any can job role team work "
    "working experience years year strong good using used use including etc such must should well able looking candidate candidates "
    "responsibilities requirements skills ability knowledge understanding plus preferred required we a an in on of to as is or at be by it"
).split()


def _normal_form(form: str, ascii_only: bool):
    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            v = unicodedata.normalize(form, v)
            return v.encode("ascii", "ignore").decode("ascii") if ascii_only else v

        return values.map(one)

    return normal


def _where_not_ascii(text: Column, form: str, ascii_only: bool) -> Column:
    """Python sees only values with other than ASCII characters; Spark has no normal forms."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _normal_form(form, ascii_only)(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def clean_text(text: Column) -> Column:
    """NFKC, no zero-width characters, single blanks, trimmed; blank is null."""
    plain = F.translate(_where_not_ascii(text, "NFKC", False), ZERO_WIDTH, "")
    return F.nullif(F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def ascii_fold(text: Column) -> Column:
    return _where_not_ascii(text, "NFKD", True)


def _spaced(text: Column) -> Column:
    """Lower-case letters and digits, in tokens parted by one blank."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(_spaced(text), " "), lambda t: t != "")


def norm_company(name: Column) -> Column:
    """Without trailing suffixes, unless nothing would be left."""
    whole = _spaced(F.coalesce(name, F.lit("")))
    short = F.regexp_replace(whole, f"(?:(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)}))+$", "")
    return F.when(short == "", whole).otherwise(short)


def norm_title(title: Column) -> Column:
    return _spaced(F.coalesce(title, F.lit("")))


def norm_location(location: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in LOCATION_ALIASES.items() for x in pair])
    return F.array_join(F.transform(tokens(F.coalesce(location, F.lit(""))), lambda t: F.coalesce(aliases[t], t)), " ")


def content_hash(company: Column, title: Column, location: Column) -> Column:
    return F.sha2(F.concat_ws("|", norm_company(company), norm_title(title), norm_location(location)), 256)


#: What counts as a token of a posting, and as a number.
KEYWORD, NUMBER = r"[a-z0-9+#.]+", r"\d[\d,]*\.?\d*"


def keyword_tokens(text: Column) -> Column:
    """Distinct tokens of letters, digits, + # and dot, of two characters or more, but no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEYWORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def numbers(text: Column) -> Column:
    """Distinct numbers, without commas and without a dot at the end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(",")), r"\.+$", "")))


def split_list(text: Column) -> Column:
    """Items between commas or line ends, trimmed, none of them empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n]"), lambda t: F.trim(t)), lambda t: t != "")


def token_sort(text: Column) -> Column:
    """Words in order, as similarity compares them; upper and lower case stay apart."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda t: t != "")), " ")


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def cut_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def opportunity_description(details: Column, skills: Column, function: Column) -> Column:
    """Details, then ``Skills: a, b``, then ``Function: f``, one a line; null where all are blank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.filter(F.transform(skills, lambda s: F.trim(F.coalesce(s["name"], F.lit("")))), lambda n: n != "")
    listed = F.when(F.size(names) > 0, F.concat(F.lit("Skills: "), F.array_join(names, ", ")))
    return F.nullif(F.concat_ws("\n", blank(details), listed, F.concat(F.lit("Function: "), blank(function))), F.lit(""))
