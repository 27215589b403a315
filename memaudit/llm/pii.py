"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates, card numbers among them by trying all runs of groups of digits; each is validated (a card
number by its check digit, a date by the calendar, an address by its octets). A valid value becomes a list of small
numbers, each below a radix of its own: digits below 10, letters below 26, octets below 256, a social security number
its valid areas, groups and serials, a date two numbers that count its days. A keyed alternating Feistel network permutes
the list: in each round the numbers at even (then odd) places move by a hash of the key, the kind, the round, the place
and all numbers at the other places. Two lists stand for no date; what lands on one is permuted again until it doesn't.
The result has the same layout and is valid again, equal values give equal pseudonyms in all documents, and unlike
values of one layout give unlike ones. A card keeps its first digit, and the first digits of a phone number's area and
exchange stay below 2 or from 2 up, as they were. Slashed dates are read month first, or day first where only that makes
a date; they keep their order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card", "secret")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_START, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: What each kind looks like; validation comes after.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _END,
    "ip": r"(?<![A-Za-z0-9.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?![Tt][0-9]{2}:?[0-9]{2})[A-Za-z0-9/-]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?:(?<![A-Za-z0-9])\+?1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![A-Za-z0-9-])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}" + _END + r"|\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}" + _END,
    "card": _START + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "secret": _START + r"AKIA[0-9A-Z]{16}" + _END + r'|(?<=(?i:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}"?)[A-Za-z0-9_-]{8,}',
}
#: Card numbers aren't searched by their pattern, which takes neighbouring numbers in: see _pattern.
BEFORE, AFTER = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in ("card", "secret")), f"(?:{PATTERNS['secret']})"
#: How issuers group a card number.
LAYOUT = r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: A text without any of these holds no candidate.
HINT = r"[0-9@]|AKIA|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"

FORMATS = ((r"^....-", "yyyy-MM-dd"), (r"^..../", "yyyy/MM/dd"), (r"^..\.", "dd.MM.yyyy"), (r"^../", "MM/dd/yyyy"))
#: Days from 1900-01-01 to 2099-12-31 are DAYS, two less than 319 x 229.
DAYS = 73_049
#: Areas of social security numbers: 1 to 899 but 666.
AREAS = 898
FIRST, YEARS, HIGH, LOW = "1900-01-01", ("1900-01-01", "2099-12-31"), 319, 229


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(s: Column) -> Column:
    """The digits of a string as an array of int."""
    return F.transform(F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))


def luhn_sum(numbers: Column, doubled_from_right: int) -> Column:
    """Luhn's sum; places counted from the right are doubled if they are doubled_from_right modulo 2."""
    n = F.size(numbers)

    def one(v: Column, i: Column) -> Column:
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((n - 1 - i) % 2 == doubled_from_right, twice).otherwise(v)

    return F.aggregate(F.transform(numbers, one), F.lit(0), lambda acc, v: acc + v)


def _cards(text: Column) -> Column:
    """All valid card numbers that begin and end on borders of groups of digits, those in an issuer's layout first, long ones first."""
    runs = [F.regexp_extract_all(text, F.lit(_START + "(?=([0-9](?:[ -]?[0-9]){%d})" % n + _END + ")"), F.lit(1)) for n in range(18, 11, -1)]
    some = F.when(text.rlike(_START + "[0-9](?:[ -]?[0-9]){12}"), F.flatten(F.array(*runs))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(some), lambda s: luhn_sum(_numbers(s), 1) % 10 == 0)


def _pattern(cards: Column) -> Column:
    """One pattern of all kinds with a text's own card numbers; one in another layout gives way to one of LAYOUT that begins in it."""
    known, other = F.filter(cards, lambda s: s.rlike(LAYOUT)), F.filter(cards, lambda s: ~s.rlike(LAYOUT))
    first = F.concat(F.lit("(?:"), F.array_join(known, "|"), F.lit(")" + _END))
    no = lambda s: F.when(F.size(known) > 0, F.concat(F.lit("(?![0-9 -]{1,"), (F.length(s) - 1).cast("string"), F.lit("}" + _START), first, F.lit(")"))).otherwise(F.lit(""))
    every = F.array_join(F.concat(known, F.transform(other, lambda s: F.concat(no(s), s))), "|")
    return F.when(F.size(cards) > 0, F.concat(F.lit(BEFORE + "|" + _START + "(?:"), every, F.lit(")" + _END + "|" + AFTER))).otherwise(F.lit(BEFORE + "|" + AFTER))


def _date(s: Column) -> Column:
    """The date that s writes, if it is one of the years covered; 31/12 dates where 12/31 makes none."""
    read = F.coalesce(
        *[F.when(s.rlike(start), F.try_to_date(s, f)) for start, f in FORMATS],
        F.when(s.rlike("^../"), F.try_to_date(s, "dd/MM/yyyy")),
    )
    return F.when(read.between(F.lit(YEARS[0]).cast("date"), F.lit(YEARS[1]).cast("date")), read)


def kind_of(s: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    area = F.substring(s, 1, 3)
    return (
        F.when(s.contains("@"), F.lit("email"))
        .when(s.rlike(full["ip"]), F.lit("ip"))
        .when(s.rlike(full["date"]), F.when(_date(s).isNotNull(), F.lit("date")))
        .when(s.rlike(full["ssn"]), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000"), F.lit("ssn")))
        .when(s.rlike(r"^\+|^1?[ .-]?\(|^(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$"), F.lit("phone"))
        .when(s.rlike(full["card"]) & (luhn_sum(_numbers(s), 1) % 10 == 0), F.lit("card"))
        .when(s.rlike("[A-Za-z]"), F.lit("secret"))
    )


#: The part of an email that stays: its last label. Of a phone number with a plus sign: the country code's first digit.
_ALNUM = "[A-Za-z0-9]"


def _moving(s: Column, kind: Column) -> Column:
    """The part of a value whose letters and digits move (of a card, all but the check digit)."""
    return (
        F.when(kind == "email", F.regexp_replace(s, r"\.[A-Za-z]+$", ""))
        .when((kind == "phone") & s.startswith("+"), F.substring(s, 3, 1 << 30))
        .when((kind == "phone") & s.rlike(r"^1[ .-]?\(|^1[ .-][0-9]"), F.substring(s, 2, 1 << 30))
        .when(kind == "card", F.regexp_replace(s, "[0-9]$", ""))
        .when((kind == "secret") & s.startswith("AKIA"), F.substring(s, 5, 1 << 30))
        .otherwise(s)
    )


def _symbols(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(_ALNUM), F.lit(0))


def _value(c: Column) -> Column:
    """Digits 0-9, letters 0-25 whatever their case."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97)


def places(s: Column, kind: Column) -> Column:
    """A value as an array of (v, r, f): the number v, its radix r, and the f above which it is written."""
    hexadecimal = (kind == "secret") & s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    moving = _symbols(_moving(s, kind))
    national = (kind == "phone") & (F.size(moving) == 10) & (~s.startswith("+") | s.startswith("+1"))

    def place(v, r, f=0) -> Column:
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for x, n in ((v, "v"), (r, "r"), (f, "f"))])

    def symbol(c: Column, i: Column) -> Column:
        v = _value(c)
        radix = F.when(c.between("0", "9"), F.lit(10)).when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
        return (
            F.when((kind == "card") & (i == 0), place(0, 1, v))
            .when(national & i.isin(0, 3), F.when(v >= 2, place(v - 2, 8, 2)).otherwise(place(v, 2)))
            .otherwise(place(v, radix))
        )

    days = F.datediff(_date(s), F.lit(FIRST).cast("date"))
    area, group, serial = (F.substring(s, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    return (
        F.when(kind == "date", F.array(place(F.floor(days / LOW), HIGH), place(days % LOW, LOW)))
        .when(kind == "ssn", F.array(place(F.when(area > 666, area - 2).otherwise(area - 1), AREAS), place(group - 1, 99), place(serial - 1, 9999)))
        .when(kind == "ip", F.transform(F.split(s, r"\."), lambda o: place(o, 256)))
        .otherwise(F.transform(moving, symbol))
    )


def permute(values: Column, radices: Column, kind: Column, key: str) -> Column:
    """The alternating Feistel network over numbers below their radices."""

    def turn(acc: Column, r: Column) -> Column:
        others = F.concat_ws(",", F.transform(F.filter(acc, lambda v, j: j % 2 != r % 2), lambda v: v.cast("string")))

        def move(v: Column, i: Column) -> Column:
            seed = F.concat_ws("|", F.lit(key), kind, r.cast("string"), i.cast("string"), others)
            shift = F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long")
            return F.when(i % 2 == r % 2, ((v + shift) % F.get(radices, i)).cast("int")).otherwise(v)

        return F.transform(acc, move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def no_date(values: Column) -> Column:
    """True for the two lists of a date's numbers that count beyond the last day."""
    return F.get(values, F.lit(0)) * LOW + F.get(values, F.lit(1)) >= DAYS


def _written(s: Column, kind: Column, moved: Column) -> Column:
    """The permuted numbers in the layout of s."""
    chars = F.split(s, "")
    start = F.length(s) - F.length(_moving(s, kind))  # what stays before the moving part, of phones and keys
    start = F.when(kind.isin("phone", "secret"), start).otherwise(F.lit(0))
    end = start + F.length(_moving(s, kind))

    def letter(v: Column, like: Column) -> Column:
        return F.when(like.between("0", "9"), v.cast("string")).when(like.between("A", "Z"), F.char(v + 65)).otherwise(F.char(v + 97))

    # Walks the characters with a counter of the letters and digits used so far.
    def step(acc: Column, i: Column) -> Column:
        c = F.get(chars, i)
        mine = (i >= start) & (i < end) & c.rlike(_ALNUM)
        return F.struct(
            F.concat(acc["out"], F.when(mine, letter(F.get(moved, acc["n"]), c)).otherwise(c)).alias("out"),
            F.when(mine, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        )

    walked = F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]
    check = F.pmod(-luhn_sum(moved, 0), F.lit(10)).cast("string")
    day = F.date_add(F.lit(FIRST).cast("date"), F.get(moved, F.lit(0)) * LOW + F.get(moved, F.lit(1)))
    dated = functools.reduce(lambda acc, f: acc.when(s.rlike(f[0]), F.date_format(day, f[1])), FORMATS[1:], F.when(s.rlike(FORMATS[0][0]), F.date_format(day, FORMATS[0][1])))
    day_first = s.rlike("^../") & F.try_to_date(s, "MM/dd/yyyy").isNull()
    at = lambda i: F.get(moved, F.lit(i))
    area = F.when(at(0) >= 665, at(0) + 2).otherwise(at(0) + 1)
    social = F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in ((area, 3), (at(1) + 1, 2), (at(2) + 1, 4))])
    return (
        F.when(kind == "date", F.when(day_first, F.date_format(day, "dd/MM/yyyy")).otherwise(dated))
        .when(kind == "ssn", social)
        .when(kind == "ip", F.concat_ws(".", F.transform(moved, lambda v: v.cast("string"))))
        .when(kind == "card", F.concat(F.substring(walked, 1, 1 << 30).substr(F.lit(1), F.length(s) - 1), check))
        .otherwise(walked)
    )


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_found, found (kind of each value replaced, in order), text: one row per input row, without a shuffle.

    Valid values of all KINDS in the whole text are replaced; all else stays, byte for byte. Null text counts as empty;
    null and repeated ids are kept; other columns are not read, whatever they are called; an empty table gives no rows. A secret is a key or a value after `token =` and the like.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    steps = docs.select(F.col(id_col), text.alias("text"))
    steps = steps.withColumn("any", _cards(F.col("text"))).withColumn("any", _pattern(F.col("any")))
    steps = steps.withColumn("m", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.col("any"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    steps = steps.withColumn("m", F.transform("m", lambda s: F.struct(s.alias("s"), kind_of(s).alias("k"))))

    def then(v) -> None:
        """Each valid candidate's list v anew, from the struct x of s, k, p (places) and v."""
        nonlocal steps
        steps = steps.withColumn("m", F.transform("m", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["p"].alias("p"), v(x).alias("v"))))

    steps = steps.withColumn("m", F.transform("m", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.when(x["k"].isNotNull(), places(x["s"], x["k"])).alias("p"))))
    then(lambda x: F.when(x["k"].isNotNull(), permute(x["p"]["v"], x["p"]["r"], x["k"], key)))
    for _ in range(HIGH * LOW - DAYS):  # a walk passes each list that is no date once at most
        then(lambda x: F.when((x["k"] == "date") & no_date(x["v"]), permute(x["v"], x["p"]["r"], x["k"], key)).otherwise(x["v"]))
    then(lambda x: F.zip_with(x["v"], x["p"]["f"], lambda v, f: v + f))
    steps = steps.withColumn("m", F.transform("m", lambda x: F.struct(x["k"].alias("k"), F.when(x["k"].isNull(), x["s"]).otherwise(_written(x["s"], x["k"], x["v"])).alias("p"))))
    pieces = F.split("text", F.col("any"), -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col("m")["p"], lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    found = F.filter(F.col("m")["k"], lambda k: k.isNotNull())
    return steps.select(id_col, F.size(found).alias("n_found"), found.alias("found"), F.when(F.size("m") > 0, joined).otherwise(F.col("text")).alias("text"))
