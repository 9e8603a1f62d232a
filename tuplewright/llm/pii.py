"""Personal data to format-preserving pseudonyms, by DataFrame functions only.

Method: a keyed Feistel network permutes each found value within its own format. The rounds add a keyed
SHA-256 digest of one half to the other, modulo the size of that half's domain, in turn. So every
pseudonym is a valid value of its kind, different values stay different, and equal values stay equal
across documents.

=====  ===========================================  ==============================================
kind   found and validated                          permuted
=====  ===========================================  ==============================================
email  local part of 64 characters at most @ name   letters and digits of the local part, in class
card   13 to 19 digits, also in groups; Luhn;       all digits but the last, which is made to check
       also beside other numbers (see _cards)
ip     four numbers of 0 to 255                     the 32-bit address
phone  +country or (area), 7 to 14 more digits      the digits after the country code
ssn    ddd-dd-dddd, no void area, group or serial   within the valid numbers
date   y-m-d, m/d/y, d/m/y, d.m.y, years 1700-2099  within the 400 years' days; what can be d/m/y only stays so
=====  ===========================================  ==============================================

A value that fails its validation is left as it is. The parts of a text between the values stay
byte for byte.

A date may open a timestamp and may have one digit for day or month; its pseudonym is then written without padding.
The key is the setting ``spark.tuplewright.pii.key``. A session without one draws a random key for itself, so its
pseudonyms can't be inverted, and don't link to those of other sessions.

Plan: one projection, no shuffle; texts without digit or @ are passed on after one plain scan, and the
network runs on found values only. Pieces and values come from ``split`` and ``regexp_extract_all`` by
the same pattern, which has no empty match, and are zipped together again.

Nulls and edge cases: a null text stays null with zero counts; other columns, null or not, are kept;
repeated rows get equal results; a text of any length is taken whole; an empty table gives no rows. A column of docs
named ``pii`` is kept; the counts' name is then longer (``pii_``).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import documents, free_name

ROUNDS = 8
KEY_SETTING = "spark.tuplewright.pii.key"
WALK = 64
KINDS = ("email", "card", "ip", "phone", "ssn", "date")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMATS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)",
    "ssn": r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:1[789]|20)[0-9]{2}-[01]?[0-9]-[0-3]?[0-9]|[0-3]?[0-9]/[0-3]?[0-9]/(?:1[789]|20)[0-9]{2}|[0-3]?[0-9]\.[01]?[0-9]\.(?:1[789]|20)[0-9]{2})(?:(?![\w/-])|(?=T[0-9]{2}))",
    "phone": r"(?:(?<![\w+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|(?<!\w)\([0-9]{3}\))(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)",
}
#: a run of digit groups of any length, in which cards are looked for; it ends before a value of another kind and before a
#: group that is glued to a letter. Punctuation may stand on either side, but a run is no number's fraction.
_OTHER = "|".join([FORMATS["ip"], FORMATS["ssn"], FORMATS["date"], "[A-Za-z0-9._%+-]{1,64}+@"])
FORMATS["card"] = rf"(?<!\w)(?<![0-9]\.)[0-9](?:(?:[ -](?!{_OTHER}|[0-9]++\w))?[0-9]){{12,}}+(?!\w)"
RUN = "^[0-9 -]{13,}+$"
MOST_DIGITS = 19  # of a card
BLOCK = 256  # groups of a run that are folded at once
LOOSE = "^[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
GROUPED = ["^[0-9]{13,19}(?![0-9])", *(f"^[0-9]{{4}}{s}{rest}(?![0-9])" for s in " -" for rest in (f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{1,3}}", f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}", f"[0-9]{{6}}{s}[0-9]{{5}}"))]
PATTERN = "|".join(FORMATS[k] for k in ("email", "ip", "ssn", "date", "card", "phone"))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(key: Column, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), other), 256)


def _rounds(state: Column, step) -> Column:
    """The state after all rounds; step(half, other, i) gives the half's new value."""

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(step(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        return F.when(i % 2 == 0, left).otherwise(F.struct(s["l"].alias("l"), step(s["r"], s["l"], i).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn)


def permute_characters(value: Column, key: Column, kind: str) -> Column:
    """The string with its digits, small and capital letters permuted each in their class (64 characters at most)."""

    def shift(half: Column, other: Column, i: Column) -> Column:
        def moved(digest: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                by = F.conv(F.substring(digest, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
                code = F.ascii(c)
                in_class = lambda first, n: F.char((code - first + by) % n + first)
                return F.when(c.rlike("[0-9]"), in_class(48, 10)).when(c.rlike("[a-z]"), in_class(97, 26)).when(c.rlike("[A-Z]"), in_class(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(half, ""), one), "")

        return F.when(F.length(half) == 0, half).otherwise(_let(_digest(key, kind, i, other), moved))

    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return _let(_rounds(start, shift), lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, key: Column, kind: str, a: int, b: int) -> Column:
    """A number of 0 to a*b-1 to another, one to one."""

    def add(n):
        return lambda half, other, i: (half + F.conv(F.substring(_digest(key, kind, i, other.cast("string")), 1, 12), 16, 10).cast("long") % n) % n

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(add(a)(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), add(b)(s["r"], s["l"], i).alias("r")))

    value = value.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda s: s["l"] * b + s["r"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last digit counted once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, j: _let(c.cast("int") * (1 + j % 2), lambda x: F.floor(x / 10) + x % 10))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def _card(value: Column, key: Column) -> Column:
    """Digits permuted under the separators; the last is the check digit."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def checked(body: Column) -> Column:
        return F.concat(body, ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("int").cast("string"))

    new = _let(permute_characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), checked)

    def laid(d: Column) -> Column:
        put = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["o"], F.substring(d, s["n"], F.lit(1))).alias("o"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["n"].alias("n")))
        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("n")), put)["o"]

    return F.when(luhn_sum(digits) % 10 == 0, F.when(F.length(digits) == F.length(value), new).otherwise(_let(new, laid)))


def _cards(run: Column, key: Column) -> Column:
    """struct(new, n): the run with its n cards replaced. At the start and after a card the longest loose run is tried
    first; there and at each later group the common groupings, so that a card between other numbers is found.

    A card is some whole groups, at most MOST_DIGITS, so each group is looked at with as many behind it, wherever it is in
    the run. Blocks of groups are folded by themselves and what they give is joined, so that the work grows with the run.
    """

    def folded(groups: Column, seps: Column, short: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            here = F.concat(F.get(seps, i), F.get(groups, i))
            window = F.zip_with(F.slice(seps, i + 1, MOST_DIGITS + 1), F.slice(short, i + 1, MOST_DIGITS + 1), lambda sep, g: F.concat(sep, g))
            rest = F.regexp_replace(F.array_join(window, ""), "^[ -]", "")

            def at(rest: Column) -> Column:
                tried = F.array(F.when(s["fresh"], F.regexp_extract(rest, LOOSE, 0)).otherwise(""), *(F.regexp_extract(rest, p, 0) for p in GROUPED))
                return F.get(F.filter(tried, lambda c: (c != "") & (luhn_sum(F.regexp_replace(c, "[^0-9]", "")) % 10 == 0)), F.lit(0))

            def moved(found: Column) -> Column:
                hit = found.isNotNull()
                new = F.when(hit, F.concat(F.get(seps, i), _card(found, key))).otherwise(here)
                behind = F.when(hit, i + F.size(F.split(found, "[ -]"))).otherwise(s["next"])
                return F.struct(F.concat(s["out"], new).alias("out"), behind.alias("next"), hit.alias("fresh"), (s["n"] + hit.cast("long")).alias("n"))

            return F.when(i < s["next"], s).otherwise(_let(_let(rest, at), moved))

        def block(s: Column, b: Column) -> Column:
            begin = F.struct(F.lit("").alias("out"), s["next"].alias("next"), s["fresh"].alias("fresh"), s["n"].alias("n"))
            places = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(groups)) - 1)
            done = F.aggregate(places, begin, step)
            return _let(done, lambda d: F.struct(F.concat(s["out"], d["out"]).alias("out"), d["next"].alias("next"), d["fresh"].alias("fresh"), d["n"].alias("n")))

        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(True).alias("fresh"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(groups) - 1) / BLOCK).cast("int")), begin, block)

    shortened = lambda groups: F.transform(groups, lambda g: F.substring(g, 1, MOST_DIGITS + 1))
    done = _let(F.split(run, "[ -]"), lambda g: _let(F.split(run, "[0-9]+"), lambda seps: _let(shortened(g), lambda short: folded(g, seps, short))))
    return _let(done, lambda s: F.struct(F.when(s["n"] > 0, s["out"]).alias("new"), s["n"].alias("n")))


def _ip(value: Column, key: Column) -> Column:
    parts = F.split(value, "[.]")
    number = ((parts[0].cast("long") * 256 + parts[1].cast("long")) * 256 + parts[2].cast("long")) * 256 + parts[3].cast("long")
    octet = lambda n, k: F.floor(n / (256**k)) % 256
    return _let(permute_number(number, key, "ip", 65536, 65536), lambda n: F.concat_ws(".", *(octet(n, k).cast("string") for k in (3, 2, 1, 0))))


def _ssn(value: Column, key: Column) -> Column:
    parts = F.split(value, "-")
    area = parts[0].cast("long")
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + parts[1].cast("long") - 1) * 9999 + parts[2].cast("long") - 1

    def written(n: Column) -> Column:
        area, group, serial = F.floor(n / (99 * 9999)), F.floor(n / 9999) % 99 + 1, n % 9999 + 1
        pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
        return F.concat_ws("-", pad(area + F.when(area >= 665, 2).otherwise(1), 3), pad(group, 2), pad(serial, 4))

    return _let(permute_number(number, key, "ssn", 898, 99 * 9999), written)


def _date(value: Column, key: Column) -> Column:
    """400 years have 146097 = 27 * 5411 days. A day that can't be a month is permuted again until it can't be one (cycle walking)."""
    first = F.lit("1700-01-01").cast("date")
    moved = lambda day: F.date_add(first, permute_number(F.datediff(day, first), key, "date", 27, 5411).cast("int"))

    def walked(day: Column) -> Column:
        start = F.struct(moved(day).alias("d"))
        step = lambda s, _: F.when(F.dayofmonth(s["d"]) > 12, s).otherwise(F.struct(moved(s["d"]).alias("d")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)["d"]

    def in_format(f: str, move=moved) -> Column:
        short = f.replace("MM", "M").replace("dd", "d")
        day = F.try_to_date(value, short)
        padded = F.length(value) == len(f)
        return F.when(day.isNotNull(), _let(move(day), lambda d: F.when(padded, F.date_format(d, f)).otherwise(F.date_format(d, short))))

    month_first = F.regexp_extract(value, "^[0-9]+", 0).cast("int") <= 12
    slashes = F.when(month_first, in_format("MM/dd/yyyy")).otherwise(in_format("dd/MM/yyyy", walked))
    return F.when(value.contains("-"), in_format("yyyy-MM-dd")).when(value.contains("/"), slashes).otherwise(in_format("dd.MM.yyyy"))


def _phone(value: Column, key: Column) -> Column:
    head = F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[^0-9]))?", 0)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.when(digits.between(8, 15), F.concat(head, permute_characters(F.substring(value, F.length(head) + 1, F.length(value)), key, "phone")))


def _email(value: Column, key: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_characters(local, key, "email"), F.substring(value, F.length(local) + 1, F.length(value)))


def kind_of(value: Column) -> Column:
    """The first kind whose whole format the value has; a card's run, whose end depends on what follows it, is told by its characters."""
    out = F
    for kind in ("email", "ip", "ssn", "date", "phone", "card"):
        test = value.contains("@") if kind == "email" else value.rlike(RUN if kind == "card" else f"^(?:{FORMATS[kind]})$")
        out = out.when(test, F.lit(kind))
    return out


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    """struct(new, n): the value's pseudonym, null if it isn't valid, and how many values of the kind it holds."""
    make = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date}
    out = F
    for name, f in make.items():
        out = out.when(kind == name, F.struct(f(value, key).alias("new"), F.lit(1).cast("long").alias("n")))
    return out.when(kind == "card", _cards(value, key))


def find(text: Column, key: Column) -> Column:
    """Array of struct(kind, value, new, n) in the text's order; kind is null and new the value where the validation failed."""

    def looked_up(v: Column) -> Column:
        return _let(kind_of(v), lambda k: _let(pseudonym(v, k, key), lambda p: F.struct(F.when(p["new"].isNotNull(), k).alias("kind"), v.alias("value"), F.coalesce(p["new"], v).alias("new"), p["n"].alias("n"))))

    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), looked_up)


def session_key(spark: SparkSession) -> str:
    """The session's key; a random one, kept for the session, where none is set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """The operator: docs with the column's values replaced, and ``pii`` = struct of a count for each kind."""
    key = key or session_key(docs.sparkSession)
    text = F.col(column).cast("string")

    def replaced(found: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), found, lambda gap, f: F.concat(gap, F.coalesce(f["new"], F.lit("")))), "")
        is_kind = lambda k: lambda f: f["kind"] == k
        counts = F.struct(*(F.aggregate(F.filter(found, is_kind(k)), F.lit(0).cast("long"), lambda s, f: s + f["n"]).alias(k) for k in KINDS))
        return F.struct(joined.alias("text"), counts.alias("pii"))

    none = F.struct(text.alias("text"), F.struct(*(F.lit(0).cast("long").alias(k) for k in KINDS)).alias("pii"))
    new, counts = free_name(docs, "_new"), free_name(docs, "pii")
    out = docs.withColumn(new, F.when(text.rlike("[0-9@]"), _let(find(text, F.lit(key)), replaced)).otherwise(none))
    return out.withColumns({column: F.col(f"{new}.text"), counts: F.col(f"{new}.pii")}).drop(new)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return pseudonymise(docs).select("doc_id", "text", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
