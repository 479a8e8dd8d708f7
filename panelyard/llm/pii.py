"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Card numbers, bank accounts, social security and telephone numbers, network addresses,
dates and the local parts of e-mail addresses are found by one expression, validated by
their own rules, and mapped by a keyed permutation of their format's valid values.  Equal
values get equal pseudonyms in every document, different values of a format different ones.
All of it is column functions on one row; texts without digit or @ are not searched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart

ROUNDS = 8
#: Symbols that one permutation takes together; longer values are cut into such chunks.
CHUNK = 18
#: The Gregorian calendar repeats after 146097 days, 189 times 773.
FIRST_DAY, CYCLE_A, CYCLE_B = "1800-01-01", 189, 773

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
CARD = r"(?<![\d.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+(.-])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([.-])\d{3}\3\d{4}|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?![\d-])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\4\d{4})(?![\d-])"
KINDS = (("email", EMAIL), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("address", ADDRESS), ("date", DATE))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def chars(s: Column) -> Column:
    return F.split(s, "")


def radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long")


def base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65).cast("long")


def random_function(key: str, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, size_a: Column | int, b: Column, size_b: Column | int, key: str, *tweak: Column) -> Column:
    """A permutation of the pairs (a, b) with a < size_a, b < size_b, as a struct (a, b).

    Rounds add a keyed function of one half to the other, modulo its own size, in turn.
    """
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        even = F.struct(((s["a"] + random_function(key, *tweak, r, s["b"]) % size_a) % size_a).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), ((s["b"] + random_function(key, *tweak, r, s["a"]) % size_b) % size_b).alias("b"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted(s: Column, key: str, kind: str) -> Column:
    """A string of ASCII letters and digits with every symbol permuted within its class."""
    pieces = F.filter(F.regexp_extract_all(s, F.lit("(.{1,%d})" % CHUNK), 1), lambda x: x != "")

    def piece(x: Column, i: Column) -> Column:
        half = F.floor(F.length(x) / 2).cast("int")
        left, right = F.substring(x, F.lit(1), half), x.substr(half + 1, F.length(x))

        def value(t: Column) -> Column:
            return F.aggregate(F.filter(chars(t), lambda c: c != ""), F.lit(0).cast("long"), lambda v, c: v * radix(c) + (F.ascii(c) - base(c)))

        def size(t: Column) -> Column:
            return F.aggregate(F.filter(chars(t), lambda c: c != ""), F.lit(1).cast("long"), lambda v, c: v * radix(c))

        def written(t: Column, v: Column) -> Column:
            back = F.aggregate(
                F.reverse(F.filter(chars(t), lambda c: c != "")),
                F.struct(v.alias("v"), F.lit("").alias("s")),
                lambda acc, c: F.struct(
                    ((acc["v"] - acc["v"] % radix(c)) / radix(c)).cast("long").alias("v"),
                    F.concat(F.char(base(c) + acc["v"] % radix(c)), acc["s"]).alias("s"),
                ),
            )
            return back["s"]

        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
        moved = feistel(value(left), size(left), value(right), size(right), key, F.lit(kind), shape, i)
        return F.transform(F.array(moved), lambda ab: F.concat(written(left, ab["a"]), written(right, ab["b"])))[0]

    return F.array_join(F.transform(pieces, piece), "")


def refilled(template: Column, symbols: Column, cls: str) -> Column:
    """The template with its characters of class ``cls`` replaced, in order, by ``symbols``."""
    other = f"[^{cls}]"

    def at(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), other, ""))
        return F.when(c.rlike(f"[{cls}]"), F.substring(symbols, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars(template), at), "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; ``doubled_first`` if the last digit is a doubled one."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("long")
        return F.when(i % 2 == (0 if doubled_first else 1), F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(chars(digits)), one), F.lit(0).cast("long"), lambda s, d: s + d)


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    whole = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(d, False) % 10 == 0, F.transform(F.array(whole), lambda w: refilled(m, w, "0-9"))[0])


def mod97(s: Column) -> Column:
    """Remainder of an IBAN body by 97, letters counted from 10."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + c.cast("long")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars(s), F.lit(0).cast("long"), step)


def iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country, body = F.substring(s, 1, 2), s.substr(F.lit(5), F.length(s))
    moved = permuted(body, key, "iban")

    def checked(b: Column) -> Column:
        check = 98 - mod97(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

    good = mod97(F.concat(body, F.substring(s, 1, 4))) == 1
    return F.when(good, F.transform(F.array(F.transform(F.array(moved), checked)[0]), lambda w: refilled(m, w, "A-Z0-9"))[0])


def ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    a = F.when(area < 666, area - 1).otherwise(area - 2) * 99 + group - 1
    moved = feistel(a, 898 * 99, serial - 1, 9999, key, F.lit("ssn"))

    def shown(s: Column) -> Column:
        g, i = s["a"] % 99, ((s["a"] - s["a"] % 99) / 99).cast("long")
        return F.format_string("%03d-%02d-%04d", F.when(i < 665, i + 1).otherwise(i + 2), g + 1, s["b"] + 1)

    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(good, F.transform(F.array(moved), shown)[0])


def phone(m: Column, key: str) -> Column:
    """National numbers by their numbering plan, others behind their first two digits.

    Area and exchange start with 2 to 9 under the plan; numbers written like one that break
    it are permuted among those that break it the same way.
    """
    d = digits_of(m)
    ten = F.substring(d, -10, 10)
    north = (~m.startswith("+")) | m.startswith("+1")
    area, rest = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 7).cast("long")

    def moved(first_area: int, areas: int, first_rest: int, rests: int) -> Column:
        pair = feistel(area - first_area, areas, rest - first_rest, rests, key, F.lit("phone"), F.lit(first_area), F.lit(first_rest))

        def shown(s: Column) -> Column:
            local = F.concat(F.lpad((s["a"] + first_area).cast("string"), 3, "0"), F.lpad((s["b"] + first_rest).cast("string"), 7, "0"))
            return refilled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), local), "0-9")

        return F.transform(F.array(pair), shown)[0]

    plan = (
        F.when(area < 200, moved(0, 200, 0, 10_000_000))
        .when(rest < 2_000_000, moved(200, 800, 0, 2_000_000))
        .otherwise(moved(200, 800, 2_000_000, 8_000_000))
    )
    far = F.concat(F.substring(d, 1, 2), permuted(d.substr(F.lit(3), F.length(d)), key, "phone"))
    return F.when(north, F.when(F.length(d).isin(10, 11), plan)).when(
        F.length(d).between(8, 15), F.transform(F.array(far), lambda w: refilled(m, w, "0-9"))[0]
    )


def address(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    good = F.forall(F.split(m, r"\."), lambda x: (x.cast("long") < 256) & ~x.rlike("^0.")) & (m != "0.0.0.0") & (m != "255.255.255.255")
    moved = feistel(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, key, F.lit("address"))

    def shown(s: Column) -> Column:
        return F.concat_ws(".", F.shiftright(s["a"], 8), s["a"] % 256, F.shiftright(s["b"], 8), s["b"] % 256)

    return F.when(good, F.transform(F.array(moved), shown)[0])


def date(m: Column, key: str) -> Column:
    """Days of the 400 years from 1800; with dots day first, with slashes month first."""
    iso = m.rlike("^....-")
    p = F.split(m, r"[-./]")
    y, mo, da = F.when(iso, p[0]).otherwise(p[2]), F.when(iso | m.contains("."), p[1]).otherwise(p[0]), F.when(iso, p[2]).when(m.contains("."), p[0]).otherwise(p[1])
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(da, 2, "0")), "yyyy-MM-dd")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = feistel(((n - n % CYCLE_B) / CYCLE_B).cast("long"), CYCLE_A, n % CYCLE_B, CYCLE_B, key, F.lit("date"))

    def shown(s: Column) -> Column:
        x = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * CYCLE_B + s["b"]).cast("int"))
        return F.when(iso, F.date_format(x, "yyyy-MM-dd")).when(m.contains("."), F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "MM/dd/yyyy"))

    return F.when(n.between(0, CYCLE_A * CYCLE_B - 1), F.transform(F.array(moved), shown)[0])


def email(m: Column, key: str) -> Column:
    """Letters and digits of the local part; the domain and other signs stay."""
    at = F.instr(m, "@")
    local, rest = F.substring(m, F.lit(1), at - 1), m.substr(at, F.length(m))
    moved = permuted(F.regexp_replace(local, "[^A-Za-z0-9]", ""), key, "email")
    return F.concat(F.transform(F.array(moved), lambda w: refilled(local, w, "A-Za-z0-9"))[0], rest)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, NULL if it is not valid."""
    return (
        F.when(m.contains("@"), email(m, key))
        .when(m.rlike("^[A-Z]{2}"), iban(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn(m, key))
        .when(m.rlike(r"^(\d+\.){3}\d+$"), address(m, key))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[./]\d{1,2}[./]\d{4}$"), date(m, key))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]"), phone(m, key))
        .otherwise(card(m, key))
    )


@apart("text")
def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """Replace personal data in a text column; adds the number of replaced places.

    The key is a parameter and the same key links values across runs.  Matches that fail
    their validation stay as they are.  NULL stays NULL with 0 places, an empty text stays
    empty; repeated rows and other columns pass through, an input column named like the
    count is replaced.  Long texts are one row of one task, whose work grows with their
    length and the number of matches.
    """
    t = F.col(f"`{text}`")
    other = df.columns
    d = df.select(*[F.col(f"`{c}`") for c in other], F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias("_m"))
    d = d.withColumn("_r", F.when(F.size("_m") > 0, F.transform("_m", lambda m: pseudonym(m, key))))
    parts = F.zip_with(F.split(t, ANY), F.zip_with("_r", "_m", lambda r, m: F.coalesce(r, m)), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    new = F.when(F.col("_r").isNotNull(), F.array_join(parts, "")).otherwise(t)
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in other]
    if count:
        columns.append(F.coalesce(F.when(F.col("_r").isNotNull(), F.size(F.filter("_r", lambda r: r.isNotNull()))), F.lit(0)).alias(count))
    return d.select(*columns)
