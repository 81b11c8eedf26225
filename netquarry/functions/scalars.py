"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_size(n: Column) -> Column:
    """Bytes in the largest fitting unit."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / float(1024**2))).otherwise(F.format_string("%.2f GB", n / float(1024**3)))
    )


def duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fmin", seconds / 60)).otherwise(F.format_string("%.2fh", seconds / 3600))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), F.lit(False))


def is_private_ipv4(text: Column) -> Column:
    """Addresses of private, loopback and link-local networks."""
    return is_ipv4(text) & text.rlike(r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")


def indicator_type(text: Column) -> Column:
    """ip, domain or other, by form alone."""
    return F.when(is_ipv4(text) | F.contains(text, F.lit(":")), "ip").when(F.contains(text, F.lit(".")), "domain").otherwise("other")


def half_even(x: Column, places: int) -> Column:
    """A double rounded as doubles are (scaled, to the nearest whole, halves to even), as DuckDB's ``round_even`` does; ``bround`` goes by its shortest decimal form: 0.575, which scales to 57.49999999999999, would be 0.58."""
    return F.rint(x * 10.0**places) / 10.0**places


def _scaled(n: Column, bytes_: str) -> Column:
    """Bytes with one place in B, KB, MB or GB (halves to even)."""
    one = lambda unit, k: F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**k), 1))
    return F.when(n < 1024, F.format_string(bytes_, n.cast("long") if "d" in bytes_ else n.cast("double"))).when(n < 1024**2, one("KB", 1)).when(n < 1024**3, one("MB", 2)).otherwise(one("GB", 3))


def summary_size(n: Column) -> Column:
    """Bytes as text summaries show them: whole bytes, one place above."""
    return _scaled(F.coalesce(n, F.lit(0)), "%d B")


def report_size(n: Column) -> Column:
    """Bytes as reports show them: always one place."""
    return _scaled(n, "%.1f B")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is written down once, so that expressions don't double at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_digits(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, null where it is none. A dotted end and a zone are allowed."""
    bare = F.lower(F.regexp_replace(text, "^([^%]*)%[^%]+$", "$1"))
    none = F.expr("cast(array() as array<string>)")

    def undotted(v: Column) -> Column:
        octets = F.split(F.regexp_extract(v, rf"^(?:.*:)({_OCTET}(?:\.{_OCTET}){{3}})$", 1), r"\.")

        def pairs(o: Column) -> Column:
            pair = lambda i: F.lower(F.hex(F.get(o, F.lit(i)).cast("int") * 256 + F.get(o, F.lit(i + 1)).cast("int")))
            return F.when(F.size(o) == 4, F.concat(F.regexp_extract(v, r"^(.*:)[^:]*$", 1), pair(0), F.lit(":"), pair(2))).otherwise(v)

        return _let(octets, pairs)

    def digits(h: Column) -> Column:
        groups = lambda i: F.coalesce(F.when(F.get(h, F.lit(i)) != "", F.split(F.get(h, F.lit(i)), ":", -1)), none)
        both = F.struct(groups(0).alias("l"), groups(1).alias("r"), F.size(h).alias("n"))

        def joined(x: Column) -> Column:
            missing = 8 - F.size(x["l"]) - F.size(x["r"])
            whole = F.when(x["n"] == 1, missing == 0).otherwise((x["n"] == 2) & (missing > 0))
            each = F.concat(x["l"], F.array_repeat(F.lit("0"), missing), x["r"])
            return F.when(whole & F.forall(each, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$"))), F.array_join(F.transform(each, lambda g: F.lpad(g, 4, "0")), ""))

        return _let(both, joined)

    return _let(F.split(_let(bare, undotted), "::", -1), digits)


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | ipv6_digits(text).isNotNull()


#: Networks that are not reached from outside, as patterns of dotted addresses and of 32 hex digits, and the exceptions inside them.
_INNER4 = r"^(?:0|10|127|24\d|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.0\.(?!(?:9|10)$)|^192\.0\.2\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
_INNER6 = "^0{31}[01]$|^0064ff9b0001|^0100000000000000|^20010[01]|^20010db8|^2002|^f[cd]|^fe[89ab]"
_OUTER6 = "^2001000100000000000000000000000[123]$|^20010003|^200100040112|^2001002|^2001003"


def is_private_ip(text: Column) -> Column:
    """Addresses of networks that are not reached from outside; an IPv4 address inside an IPv6 one counts as itself. False where it is no address."""

    def six(d: Column) -> Column:
        inner = F.array_join(F.transform(F.sequence(F.lit(25), F.lit(31), F.lit(2)), lambda i: F.conv(F.substr(d, i, F.lit(2)), 16, 10)), ".")
        return F.when(F.rlike(d, F.lit("^0{20}ffff")), F.rlike(inner, F.lit(_INNER4))).otherwise(F.rlike(d, F.lit(_INNER6)) & ~F.rlike(d, F.lit(_OUTER6)))

    return F.coalesce(F.when(is_ipv4(text), F.rlike(text, F.lit(_INNER4))).otherwise(_let(ipv6_digits(text), six)), F.lit(False))
