"""Scalar expressions on numbers, dates, ids, urls and names. All are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visit, and the classes of publishers by domain ending.
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)"
TLD_CLASS = (("gov", "government"), ("mil", "government"), ("int", "intergovernmental"), ("edu", "academic"), ("org", "ngo"))


def plain_number(text: Column) -> Column:
    """A whole string as decimal(38,10): digits, grouped integers, decimals with point or comma; null if unclear.

    Groups of three after `,`, `.` or a blank are thousands, except after a leading zero; one or two digits after a
    comma are decimals. Out of range gives null.
    """
    t = F.trim(text)
    kind = lambda p: t.rlike(p)
    cleaned = (
        F.when(kind(r"^-?[0-9]+$"), t)
        .when(kind(r"^-?0[.,][0-9]+$"), F.translate(t, ",", "."))
        .when(kind(r"^-?[1-9][0-9]{0,2}([, ][0-9]{3})+(\.[0-9]+)?$") & ~kind(r"^-?[0-9]+,[0-9]{3} "), F.regexp_replace(t, "[, ]", ""))
        .when(kind(r"^-?[1-9][0-9]{0,2}(\.[0-9]{3})+(,[0-9]+)?$"), F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(kind(r"^-?[0-9]+\.[0-9]+$"), t)
        .when(kind(r"^-?[0-9]+,[0-9]{1,2}$"), F.translate(t, ",", "."))
    )
    return cleaned.try_cast("decimal(38,10)")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port, trailing host dot or tracking parameters, path `/` if none; null without a scheme or host."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[^:]+://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"\.$", "")
    path = F.regexp_extract(bare, r"^[^:]+://[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when((scheme != "") & (host != ""), whole)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#:]*)", 1))


def publisher_class(host: Column, known: dict[str, str]) -> Column:
    """Class by the longest known domain that the host is or belongs to, then by its ending, else other."""
    out = F.lit("other")
    for tld, kind in reversed(TLD_CLASS):
        out = F.when(host.rlike(rf"\.{tld}(\.[a-z]{{2}})?$"), kind).otherwise(out)
    for domain in sorted(known, key=lambda d: (len(d), d)):
        out = F.when((host == domain) | host.endswith("." + domain), known[domain]).otherwise(out)
    return out


def collapse(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def entity_key(name: Column) -> Column:
    """Lower case without a leading `the`, runs of other than letters and digits joined by `-`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"^the ", ""), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def months_apart(early: Column, late: Column) -> Column:
    """Whole months from one date to a later one."""
    full = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    return full - F.when(F.dayofmonth(late) < F.dayofmonth(early), 1).otherwise(0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-derived id: the same parts give the same id on each run, so sinks can drop what they have."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 26))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def token_estimate(text: Column) -> Column:
    """A quarter token for each ASCII character, a half for others, one for wide scripts; half to even."""
    wide = F.length(F.regexp_replace(text, r"[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x{00}-\x{7F}]", ""))
    return F.bround(ascii_ / 4 + (F.length(text) - ascii_ - wide) / 2 + wide, 0).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct three-character parts of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    parts = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 when a norm is 0."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
