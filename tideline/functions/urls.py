"""URLs by regular expressions, which take any text; nothing here raises on a bad one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track; utm_* is dropped as well.
TRACKING = "gclid fbclid mc_cid mc_eid ref referrer source src trk trackingid refid originalsubdomain position pagenum utm_id".split()
#: Labels before a country that belong to the suffix.
SECOND_LEVEL = "co com org net ac gov edu".split()
#: Host parts that tell an applicant system, in order.
SYSTEM_HOSTS = (("greenhouse", ("greenhouse.io",)), ("lever", ("lever.co",)), ("ashby", ("ashbyhq.com",)), ("smartrecruiters", ("smartrecruiters.com",)))
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PARTS, k)


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(F.trim(F.coalesce(url, F.lit(""))), 2), r"^.*@", ""), r":\d*$", ""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or blank query values, sorted pairs, no slash at the end.

    Blank is ''; a text without scheme and host stays; other schemes than http and https give ''.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme, netloc, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), _part(u, 4)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.+$")), lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    short = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    whole = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), netloc, F.when((netloc != "") & (short != "") & ~short.startswith("/"), F.concat(F.lit("/"), short)).otherwise(short), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
    return F.when((u == "") | ((scheme == "") & (netloc == "")), u).when((scheme != "") & ~scheme.isin("http", "https"), "").otherwise(whole)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    """As a form does; Spark's encoder also escapes ~ and leaves * as it is."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def base_domain(name: Column) -> Column:
    """The registrable part of a host: two labels, or three behind co.in and the like."""
    labels = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\."), lambda x: x != "")
    n = F.size(labels)
    three = (n > 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (F.length(F.try_element_at(labels, F.lit(-1))) <= 3)
    return F.array_join(F.slice(labels, F.greatest(n - F.when(three, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")


def is_private_host(url: Column) -> Column:
    """localhost, .local, loopback or a private address; a text without host counts as local."""
    h = host(url)
    return (h == "") | (h == "localhost") | h.endswith(".local") | h.rlike(r"^(?:10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^0\.\d+\.\d+\.\d+$")


def has_safe_scheme(url: Column) -> Column:
    return F.lower(_part(F.trim(F.coalesce(url, F.lit(""))), 1)).isin("http", "https", "mailto")


def is_page_of(url: Column, domain: str) -> Column:
    """The host is the domain or under it; a text that only mentions it is not."""
    h = host(url)
    return _part(F.trim(F.coalesce(url, F.lit(""))), 1).isin("http", "https") & ((h == domain) | h.endswith(f".{domain}"))


def applicant_system(url: Column) -> Column:
    """The first system whose host part the URL's host holds."""
    h = host(url)
    hits = [F.when(F.coalesce(*[F.when(h.contains(m), True) for m in marks], F.lit(False)), name) for name, marks in SYSTEM_HOSTS]
    return F.coalesce(*hits)


def opportunity_url(absolute: Column, relative: Column, short: Column, base: str = "https://unstop.com") -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    joined = F.when(relative.rlike("^https?://"), relative).otherwise(F.concat(F.lit(f"{base}/"), F.regexp_replace(relative, "^/+", "")))
    return F.coalesce(filled(absolute), F.when(filled(relative).isNotNull(), joined), short, F.lit(""))
