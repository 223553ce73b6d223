"""What texts say in numbers, names and signs: values as written, sample sizes, number gates, keys and preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.values import plain_number

#: A number as it may be written, the ways to write a percentage, and what stands between two ends.
NUMBER = r"[0-9][0-9., ]*[0-9]|[0-9]"
PERCENT = r"(?:%|per ?cent)"
BETWEEN = r"(?:-|to)"
_CI = rf"^({NUMBER})\s*({PERCENT})?\s*\(\s*95\s*%\s*ci\s*:?\s*({NUMBER})\s*{PERCENT}?\s*{BETWEEN}\s*({NUMBER})\s*{PERCENT}?\s*\)$"
_RANGE = rf"^({NUMBER})\s*{PERCENT}?\s*{BETWEEN}\s*({NUMBER})\s*{PERCENT}$"
_SHARE = rf"^({NUMBER})\s*{PERCENT}$"
_RATE = rf"^({NUMBER})\s*per\s*100[ ,.]?000$"
_GROUPED = r"^[1-9][0-9]{0,2}(?:(?:,[0-9]{3})+|(?:\.[0-9]{3})+|(?: [0-9]{3})+)$"
_ONE_GROUP = r"^[1-9][0-9]{0,2}[.,][0-9]{3}$"


def cleaned(text: Column) -> Column:
    """Lower case, every dash a hyphen, every blank a space, runs of them one."""
    plain = F.translate(text, "–—−   ％", "---   %")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def written_value(text: Column) -> Column:
    """struct(value, unit, lower, upper, unparsed) of a value as written.

    A percentage with or without a 95 % interval, a range of percentages (never its middle), a rate per 100,000, or a
    count with thousands groups. One group of three digits in a percentage may be thousands or decimals and isn't
    guessed; a bare number may be a year. What doesn't match is unparsed.
    """
    t = cleaned(text)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    def number(pattern: str, group: int) -> Column:
        return plain_number(part(pattern, group)).cast("double")

    def unclear(pattern: str, *groups: int) -> Column:
        out = F.lit(False)
        for g in groups:
            out = out | part(pattern, g).rlike(_ONE_GROUP)
        return out

    none = F.lit(None).cast("double")

    def found(value: Column, unit: Column | str, lower: Column, upper: Column) -> Column:
        return F.struct(value.alias("value"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"), lower.alias("lower"), upper.alias("upper"), F.lit(False).alias("unparsed"))

    nothing = F.struct(none.alias("value"), F.lit(None).cast("string").alias("unit"), none.alias("lower"), none.alias("upper"), F.lit(True).alias("unparsed"))

    def if_all(*numbers: Column) -> Column:
        out = F.lit(True)
        for n in numbers:
            out = out & n.isNotNull()
        return out

    v, low, high = number(_CI, 1), number(_CI, 3), number(_CI, 4)
    percent = part(_CI, 2) != ""
    interval = F.when(if_all(v, low, high) & ~(percent & unclear(_CI, 1, 3, 4)), found(v, F.when(percent, "percent"), low, high)).otherwise(nothing)
    a, b = number(_RANGE, 1), number(_RANGE, 2)
    between = F.when(if_all(a, b) & ~unclear(_RANGE, 1, 2), found(none, "percent", a, b)).otherwise(nothing)
    share = F.when(if_all(number(_SHARE, 1)) & ~unclear(_SHARE, 1), found(number(_SHARE, 1), "percent", none, none)).otherwise(nothing)
    rate = F.when(if_all(number(_RATE, 1)), found(number(_RATE, 1), "per_100k", none, none)).otherwise(nothing)
    count = F.when(if_all(plain_number(t)), found(plain_number(t).cast("double"), "count", none, none)).otherwise(nothing)
    return F.when(t.rlike(_CI), interval).when(t.rlike(_RANGE), between).when(t.rlike(_SHARE), share).when(t.rlike(_RATE), rate).when(t.rlike(_GROUPED), count).otherwise(nothing)


def sample_size(text: Column) -> Column:
    """The one whole number of people in a text, null if there are several, a decimal or none."""
    t = F.regexp_replace(cleaned(text), r"([0-9])[ ,.]([0-9]{3})\b", "$1$2")
    found = F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    n = F.when((F.size(found) == 1) & ~t.rlike(r"[0-9][.,][0-9]{1,2}\b"), F.try_element_at(found, F.lit(1)).try_cast("long"))
    return F.when(n > 0, n)


def number_tokens(text: Column) -> Column:
    """Distinct numbers of a text, with their decimals and groups, bare years left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^(19|20)[0-9]{2}$")))


def writings(n: Column) -> Column:
    """A whole number as it may stand in a text: plain, with a zero decimal, or with thousands grouped."""
    plain = n.cast("long").cast("string")
    grouped = F.format_number(n.cast("long"), 0)
    return F.array_distinct(F.array(plain, F.concat(plain, F.lit(".0")), F.concat(plain, F.lit(",0")), grouped, F.translate(grouped, ",", ".")))


def stands_in(n: Column, text: Column) -> Column:
    """Whether a whole number stands in a text as a whole token, in any of its writings."""
    return F.arrays_overlap(writings(n), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))


def names_in(text: Column) -> Column:
    """Distinct capitalised runs of two words or more, and acronyms."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}"), F.lit(0)))


def words(text: Column, stop: list[str], own: Column) -> Column:
    """Words of a question in order, once each, without stop words and the words of its city."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.array_except(F.array_except(found, F.array(*[F.lit(s) for s in stop])), F.split(F.lower(own), " +")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based uuid (version 5) in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def base32(hex_: Column, chars: int) -> Column:
    """The first `chars` (a multiple of four) base-32 letters of a hexadecimal digest."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    groups = [F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int") for i in range(chars // 4)]
    return F.concat(*[F.substring(alphabet, F.shiftright(g, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for g in groups for k in range(4)])


def address_number(address: Column) -> Column:
    """A dotted IPv4 address as a number, null if it is none."""
    parts = F.transform(F.split(address, r"\."), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.cast("long")))
    ok = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


#: IPv4 networks that aren't public, as (first address, prefix length).
CLOSED_NETWORKS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def is_public(address: Column) -> Column:
    """Whether a fetch may go to an IPv4 address; IPv6-mapped ones count as what they map."""
    n = address_number(F.regexp_replace(address, "^::ffff:", ""))
    closed = F.lit(False)
    for first, length in CLOSED_NETWORKS:
        a, b, c, e = map(int, first.split("."))
        closed = closed | (F.shiftright(n, 32 - length) == (((a << 24) + (b << 16) + (c << 8) + e) >> (32 - length)))
    return F.coalesce(~closed, F.lit(False))


def preferences(header: Column) -> Column:
    """`k=v` pairs of a usage header as a map, keys and values in lower case; later ones win."""
    pairs = F.filter(F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), "[,;]"), lambda p: F.trim(p)), lambda p: p.rlike("^[a-z-]+=[a-z]+$"))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    last = F.filter(pairs, lambda p, i: F.array_position(F.reverse(keys), F.get(keys, i)) == F.size(keys) - i)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1))))


def retry_after(value: Column, now: Column, most: int) -> Column:
    """Seconds to wait by a Retry-After header, given as seconds or as a date; at most `most`, null if unreadable."""
    at = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(value.rlike("^[0-9]{1,9}$"), value.try_cast("long")).otherwise(F.unix_timestamp(at) - F.unix_timestamp(now))
    return F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0).cast("long")), F.lit(most).cast("long")))
