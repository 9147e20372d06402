"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame functions alone.

Emails, payment cards, IBANs, phone numbers, social security numbers, IPv4 addresses and calendar dates are found by one
pattern, validated (check digits, ranges, calendar), and permuted within their own format: a card stays a card with a right check
digit, a date stays a date in its notation, separators stay where they are. What doesn't validate is left as it is. Since the
permutation depends on the key, the kind and the value's bare digits alone, a value has the same pseudonym in every document and
notation, and without the key nothing leads back.

Two networks are used. Values with a numeric range are numbered from 0 and permuted as (left, right) in Z_a x Z_b with a * b equal
to the size of the range, so nothing falls outside. Other values are permuted by characters: each character of one half is shifted within its
class (digits, small letters, capitals) by amounts that depend on the other half.

Round functions are SHA-256 of key, kind, round and half. An email's domain has labels of 63 characters and 126 labels before its last at most, as in
the domain name system; every repeated group of the pattern is bounded, so matching needs no deep stack and linear time on long texts.

Null texts stay null with 0 values; empty texts and others without findings are returned unchanged; an empty table gives an empty one. Repeated rows get
equal results. All other columns pass through; ``n_values`` is replaced. The key stands in the query's plan: set ``spark.sql.redaction.string.regex`` where plans are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Key of the registered queries alone; it protects nothing.
DEMO_KEY = "millrace demonstration key"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DAY_DATE = r"(?<![\d/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?!\d|[/.]\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|(?:1[ .\-])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4})(?!\d)"
WORLD = r"(?<![\d+])\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?![\d])"
CARD = r"(?<!\d|\d[.\-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: The back reference of DAY_DATE is the pattern's only group.
ANY = "|".join([EMAIL, IPV4, ISO_DATE, DAY_DATE, SSN, PHONE, WORLD, CARD, IBAN])
#: Days of the Gregorian cycle of 400 years from EPOCH, and two factors of their number.
EPOCH, CYCLE, CYCLE_FACTORS = "1800-01-01", 146_097, (189, 773)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(e: Column | str) -> Column:
    return (F.lit(e) if isinstance(e, str) else e).try_cast("bigint")


def _draw(key: str, kind: str, turn: Column, half: Column) -> Column:
    """Fifteen hex digits of SHA-256 as a number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permute(number: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""

    def step(s: Column, i: Column) -> Column:
        left, right = s["left"], s["right"]
        return F.when(i % 2 == 1, F.struct(F.pmod(left + _draw(key, kind, i, right.cast("string")) % a, F.lit(a).cast("bigint")).alias("left"), right.alias("right"))).otherwise(
            F.struct(left.alias("left"), F.pmod(right + _draw(key, kind, i, left.cast("string")) % b, F.lit(b).cast("bigint")).alias("right"))
        )

    start = F.struct(F.floor(number / b).cast("bigint").alias("left"), F.pmod(number, F.lit(b).cast("bigint")).alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["left"] * b + s["right"])


def _shift(half: Column, other: Column, turn: Column, key: str, kind: str) -> Column:
    """Each character of ``half`` shifted within its class, by draws from its place and a digest of the other half."""

    def whole(digest: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            code = F.ascii(c)
            n = F.conv(F.substring(F.sha2(F.concat_ws("|", digest, j.cast("string")), 256), 1, 15), 16, 10).cast("bigint")
            ring = lambda base, size: F.char((F.lit(base) + F.pmod(code - base + n, F.lit(size))).cast("bigint"))
            return F.when(code.between(48, 57), ring(48, 10)).when(code.between(97, 122), ring(97, 26)).when(code.between(65, 90), ring(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256)
    return F.when(F.length(half) > 0, let(digest, whole)).otherwise(F.lit(""))


def permute_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the ASCII strings that have the same classes of characters place by place."""

    def whole(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), cut).alias("left"), F.substr(v, cut + 1, F.length(v)).alias("right"))

        def step(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 1, F.struct(s["left"].alias("left"), _shift(s["right"], s["left"], i, key, kind).alias("right"))).otherwise(
                F.struct(_shift(s["left"], s["right"], i, key, kind).alias("left"), s["right"].alias("right"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["left"], s["right"]))

    return let(value, whole)


def _bare(match: Column, keep: str = "0-9") -> Column:
    return F.regexp_replace(match, f"[^{keep}]", "")


def refill(match: Column, bare: Column, keep: str = "0-9") -> Column:
    """``match`` with its characters of the class ``keep`` replaced in order by those of ``bare``."""
    place = lambda i: F.length(_bare(F.substr(match, F.lit(1), i), keep))
    one = lambda i: F.when(F.substr(match, i, F.lit(1)).rlike(f"^[{keep}]$"), F.substr(bare, place(i), F.lit(1))).otherwise(F.substr(match, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), one), "")


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn's sum; ``doubled_from`` 0: the last digit is not doubled, 1: it is."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _whole(F.substr(digits, i, F.lit(1)))
        return total + F.when((n - i + doubled_from) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"), add)


def mod97(bare: Column) -> Column:
    """The number of an IBAN, head moved to its end and letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0).cast("bigint"), add)


def _date(day: Column, key: str) -> Column:
    """Pseudonym of a date within the 400 years from EPOCH."""
    start = F.to_date(F.lit(EPOCH))
    return F.date_add(start, permute(F.date_diff(day, start).cast("bigint"), *CYCLE_FACTORS, key, "date").cast("int"))


def _in_cycle(day: Column) -> Column:
    start = F.to_date(F.lit(EPOCH))
    return day.isNotNull() & (F.date_diff(day, start) >= 0) & (F.date_diff(day, start) < CYCLE)


def _day_date(m: Column) -> Column:
    """Date of a notation with day and month in front; a month first if it must be, or if slashes leave it open."""
    parts = F.split(m, "[/.]")
    first, second, year = (F.lpad(F.get(parts, F.lit(i)), n, "0") for i, n in ((0, 2), (1, 2), (2, 4)))
    month_first = _month_first(m)
    return F.try_to_date(F.concat_ws("-", year, F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)), "yyyy-MM-dd")


def _month_first(m: Column) -> Column:
    parts = F.split(m, "[/.]")
    first, second = _whole(F.get(parts, F.lit(0))), _whole(F.get(parts, F.lit(1)))
    return F.when(second > 12, F.lit(True)).when(first > 12, F.lit(False)).otherwise(F.contains(m, F.lit("/")))


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of one match, null if it isn't valid."""
    full = lambda pattern: m.rlike(f"^(?:{pattern})$")
    d = _bare(m)

    octets = F.split(m, "\\.")
    octet = lambda i: _whole(F.get(octets, F.lit(i)))
    address = permute(octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3), 65536, 65536, key, "ipv4")
    dotted = let(address, lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / f), F.lit(256).cast("bigint")).cast("string") for f in (16777216, 65536, 256, 1)]))

    area, group, serial = (_whole(F.substring(d, a, n)) for a, n in ((1, 3), (4, 2), (6, 4)))
    person = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def social(x: Column) -> Column:
        index = F.floor(x / (99 * 9999))
        return F.concat_ws("-", F.lpad((index + F.when(index >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(x / 9999), F.lit(99).cast("bigint")) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(9999).cast("bigint")) + 1).cast("string"), 4, "0"))

    line = F.substr(d, F.length(d) - 9, F.lit(10))
    subscriber = ((_whole(F.substring(line, 1, 3)) - 200) * 800 + _whole(F.substring(line, 4, 3)) - 200) * 10000 + _whole(F.substring(line, 7, 4))
    spread = lambda x: F.concat((F.floor(x / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(x / 10_000), F.lit(800).cast("bigint")) + 200).cast("string"), F.lpad(F.pmod(x, F.lit(10_000).cast("bigint")).cast("string"), 4, "0"))
    numbered = line.rlike("^[2-9]..[2-9]")
    loose = let(permute_text(F.concat(F.substring(line, 2, 2), F.substring(line, 5, 6)), key, "loose phone"), lambda x: F.concat(F.substring(line, 1, 1), F.substring(x, 1, 2), F.substring(line, 4, 1), F.substring(x, 3, 6)))
    # outside the numbering plan, the two digits that tell so stay
    dialled = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(numbered, let(permute(subscriber, 640_000, 10_000, key, "phone"), spread)).otherwise(loose))

    country = F.regexp_extract(m, r"^\+(\d{1,3})", 1)
    abroad = F.concat(country, permute_text(F.substr(d, F.length(country) + 1, F.length(d)), key, "phone"))

    body = F.concat(F.substring(d, 1, 1), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    card = let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 1), F.lit(10).cast("bigint")).cast("string")))

    bare = _bare(m, "A-Z0-9")
    account = let(permute_text(F.substr(bare, F.lit(5), F.length(bare)), key, "iban"), lambda x: F.concat(F.substring(bare, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(bare, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))

    user = F.substring_index(m, "@", 1)
    iso, other = F.try_to_date(m, "yyyy-MM-dd"), _day_date(m)
    pad = lambda x: F.when(F.length(F.regexp_extract(m, r"^\d+[/.]\d+", 0)) == 5, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    mark = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    in_order = lambda t, first: F.when(_month_first(m) == F.lit(first), pad(F.month(t))).otherwise(pad(F.day(t)))
    written = let(_date(other, key), lambda t: F.concat(in_order(t, True), mark, in_order(t, False), mark, F.year(t).cast("string")))
    return (
        F.when(F.contains(m, F.lit("@")), F.concat(permute_text(user, key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(full(IPV4), F.when((octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256), dotted))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(_in_cycle(iso), F.date_format(_date(iso, key), "yyyy-MM-dd")))
        .when(m.rlike(r"^\d{1,2}([/.])\d{1,2}\1\d{4}$"), F.when(_in_cycle(other), written))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(permute(person, 88_902, 9_999, key, "ssn"), social)))
        .when(m.rlike(f"^(?:{PHONE})$"), refill(m, dialled))
        .when(m.rlike(r"^\+"), F.when(F.length(d).between(8, 15), refill(m, abroad)))
        .when(m.rlike("^[A-Z]"), F.when((F.length(bare).between(15, 34)) & (mod97(bare) == 1), refill(m, account, "A-Z0-9")))
        .otherwise(F.when((luhn_sum(d, 0) % 10 == 0) & d.rlike("[1-9]"), refill(m, card)))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every valid value in ``text`` replaced by its pseudonym, and ``n_values``, how many there were."""

    def rebuild(found: Column) -> Column:
        def swap(done: Column) -> Column:
            # the gaps between matches, then match by match what stands for it
            gaps = F.split(F.col("text"), ANY)
            pairs = F.zip_with(gaps, done, lambda gap, x: F.concat(gap, F.coalesce(x["to"], F.lit(""))))
            return F.struct(F.array_join(pairs, "").alias("text"), F.size(F.filter(done, lambda x: x["valid"])).alias("n_values"))

        made = F.transform(found, lambda m: let(pseudonym(m, key), lambda p: F.struct(F.coalesce(p, m).alias("to"), p.isNotNull().alias("valid"))))
        return F.when(F.size(found) > 0, let(made, swap)).otherwise(F.struct(F.col("text").alias("text"), F.lit(0).alias("n_values")))

    # any value holds a digit or an at sign
    worth = F.col("text").rlike(r"[0-9@]")
    new = F.when(worth, let(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), rebuild)).otherwise(F.struct(F.col("text").alias("text"), F.lit(0).alias("n_values")))
    rest = [n for n in docs.columns if n not in ("text", "n_values")]
    out = docs.select(*[F.col(n) for n in rest], new.alias("__new"))
    names = [n if n != "text" else None for n in docs.columns if n != "n_values"]
    return out.select(*[F.col(n) if n else F.col("__new.text").alias("text") for n in names], F.col("__new.n_values").alias("n_values"))


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_values, text of every document, with pseudonyms for personal data."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DEMO_KEY).select("doc_id", "n_values", "text")
