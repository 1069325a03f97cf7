"""PII as format-preserving pseudonyms, in Spark functions alone.

A pattern finds candidates of each kind; validation (Luhn, month lengths, octets, IBAN check digits) decides. Valid values go through a
keyed Feistel network on their own format, so that a value has one pseudonym everywhere and different values have different ones:

* cards: a permutation of all digits but the last, which is then set by Luhn; separators stay;
* phone numbers: of all digits but those of the country code;  social security numbers: of the valid ones;
* IBANs: of the digits among the account's characters, with check digits made anew;
* IPv4 addresses: of the 32 bits;  dates: of the days of 1800 to 2199 (189 * 773 of them), in the order of fields that the date had.

E-mail addresses aren't numbers: their local part and their domain become letters and digits of keyed hashes (of 96 and 80 bits, so that equal ones for different values aren't to be expected), under example.invalid.

The network is unbalanced and alternates two halves of sizes a and b: x = (x + f(y)) mod a, y = (y + f(x)) mod b, f keyed SHA-256 of the round,
kind and other half. Each step can be undone, so it is a permutation of a * b values for any sizes.

A card or IBAN is looked for at every start and of every length among its neighbours, cards in their usual groups and then the longest valid one first, so that a number or word beside
it hides nothing. Texts are cut kind by kind: e-mail addresses, IBANs, then addresses, dates and social security numbers, then cards, then phones.

Defined results: a null text stays null, an empty one empty; invalid candidates stay as they are; the order of kinds decides
where patterns overlap; every row is treated by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


@dataclass(frozen=True)
class Kind:
    """A kind of value: its name and pattern. No pattern has groups."""

    name: str
    pattern: str


_NO_DIGIT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: What candidates look like, first kinds first. Repeats are bounded, so that no text takes more than linear time.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"),
    Kind("iban", _NO_DIGIT[0] + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _NO_DIGIT[1]),
    Kind("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    Kind("date", _NO_DIGIT[0] + r"(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})" + _NO_DIGIT[1]),
    Kind("ssn", _NO_DIGIT[0] + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    Kind("card", r"(?<![0-9A-Za-z]|[0-9][-\x20])[0-9](?:[-\x20]?[0-9]){12,18}" + _NO_DIGIT[1]),
    Kind("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[-.\x20]?)?(?:\([0-9]{2,4}\)[-.\x20]?|[0-9]{2,4}[-.\x20])[0-9]{3,4}[-.\x20][0-9]{3,5}" + _NO_DIGIT[1]),
)

#: Candidates in the order in which they are tried: cards in their usual groups, then those of one exact size, the largest first.
#: Each pattern is of no width with the candidate as its group, so that candidates may overlap.
_USUAL = ("[0-9]{13,19}", *(rf"[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}" for s in (r"\x20", "-")), *(rf"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in (r"\x20", "-")))
SIZED = {
    "iban": tuple(rf"{_NO_DIGIT[0]}(?=([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n}}}{rf'\x20?[A-Z0-9]{{{t}}}' if t else ''}){_NO_DIGIT[1]})" for n in range(7, 1, -1) for t in range(3, -1, -1)),
    "card": tuple(f"{_NO_DIGIT[0]}(?=({c}){_NO_DIGIT[1]})" for c in [*_USUAL, *(rf"[0-9](?:[-\x20]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1))]),
}
#: A text in which one of these isn't found has no candidate of any size.
_ANY = {"iban": _NO_DIGIT[0] + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2}", "card": _NO_DIGIT[0] + r"[0-9](?:[-\x20]?[0-9]){12}"}


def _hashed(key: str, kind: str, step: Column, half: Column) -> Column:
    """52 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string"), F.lit(key)), 256), 1, 13), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, kind: str, undo: bool = False) -> Column:
    """struct(x, y) of the permutation of pairs with x below a and y below b (long), or of its inverse."""
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_x = F.pmod(acc["x"] + sign * (_hashed(key, kind, i, acc["y"]) % a), a)
        moved_y = F.pmod(acc["y"] + sign * (_hashed(key, kind, i, acc["x"]) % b), b)
        return F.struct(F.when(even, moved_x).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise(moved_y).alias("y"))

    return F.aggregate(steps, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def permuted_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A permutation of the strings of as many digits (2 to 34)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, right).cast("long"), ten(left), ten(right), key, f"{kind}", undo)
    return F.concat(F.lpad(out["x"].cast("string"), left, "0"), F.lpad(out["y"].cast("string"), right, "0"))


def refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order by digits; everything else stays."""
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    end = F.aggregate(chars, start, lambda acc, c: F.when((c >= "0") & (c <= "9"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))))
    return end["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, whose last counts once."""
    backward = F.split(F.reverse(digits), "")
    doubled = F.transform(backward, lambda c, i: F.when(i % 2 == 1, F.when(c >= "5", 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d)


def _remainder_97(text: Column) -> Column:
    """The number that a text of digits and capital letters (A is 10) stands for, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when((c >= "0") & (c <= "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _card(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_is_card(v), refill(v, F.concat(body, check))).otherwise(v)


def _is_card(v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    return (luhn_sum(digits) % 10 == 0) & F.length(digits).between(13, 19)


def _phone(v: Column, key: str) -> Column:
    country = F.regexp_extract(v, r"^\+[0-9]{1,3}(?![0-9])", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.when(F.length(digits).between(7, 12), F.concat(country, refill(rest, permuted_digits(digits, key, "phone")))).otherwise(v)


def _ssn(v: Column, key: str) -> Column:
    """A permutation of the valid numbers: 898 areas (001 to 899 without 666), 99 groups, 9999 serials."""
    area, group, serial = F.substring(v, 1, 3).cast("long"), F.substring(v, 5, 2).cast("long"), F.substring(v, 8, 4).cast("long")
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def made(o: Column) -> Column:
        new = o["x"] + F.when(o["x"] >= 665, 2).otherwise(1)
        return F.concat(F.lpad(new.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(o["y"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((o["y"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(out, made)).otherwise(v)


def _iban(v: Column, key: str) -> Column:
    bare = F.regexp_replace(v, " ", "")
    head, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    digits = F.regexp_replace(account, "[^0-9]", "")
    new = refill(account, permuted_digits(digits, key, "iban"))
    check = F.lpad((98 - _remainder_97(F.concat(new, head, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_is_iban(v), refill(v, F.concat(check, F.regexp_replace(new, "[^0-9]", "")))).otherwise(v)


def _is_iban(v: Column) -> Column:
    bare = F.regexp_replace(v, " ", "")
    account = F.substring(bare, F.lit(5), F.length(bare))
    return (_remainder_97(F.concat(account, F.substring(bare, 1, 4))) == 1) & (F.length(F.regexp_replace(account, "[^0-9]", "")) >= 2)


def _ip(v: Column, key: str) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    octet = [F.get(parts, i) for i in range(4)]
    valid = reduce(lambda p, q: p & q, [(o <= 255) for o in octet]) & ~v.rlike(r"(^|\.)0[0-9]")
    out = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.when(valid, F.concat_ws(".", *(F.floor(out[h] / 256 % 256).cast("string") if i == 0 else (out[h] % 256).cast("string") for h in ("x", "y") for i in (0, 1)))).otherwise(v)


def _date(v: Column, key: str) -> Column:
    year_first = v.rlike("^[0-9]{4}")
    fields = F.split(v, r"[-/.]")
    separators = F.regexp_replace(v, "[0-9]", "")
    first, middle, last = (F.get(fields, i) for i in range(3))
    day_first = ~year_first & (middle.cast("int") <= 12)
    year = F.when(year_first, first).otherwise(last)
    month = F.when(year_first | day_first, middle).otherwise(first)
    day = F.when(year_first, last).when(day_first, first).otherwise(middle)
    date = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    number = F.datediff(date, F.lit("1800-01-01").cast("date"))
    out = feistel(F.floor(number / 773), number % 773, F.lit(189), F.lit(773), key, "date")
    new = F.date_add(F.lit("1800-01-01").cast("date"), (out["x"] * 773 + out["y"]).cast("int"))
    y, m, d = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
    s1, s2 = F.substring(separators, 1, 1), F.substring(separators, 2, 1)
    made = F.when(year_first, F.concat(y, s1, m, s2, d)).when(day_first, F.concat(d, s1, m, s2, y)).otherwise(F.concat(m, s1, d, s2, y))
    return F.when(date.isNotNull() & number.between(0, 146096), made).otherwise(v)


def _email(v: Column, key: str) -> Column:
    low = F.lower(v)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), low), 256), 1, 24), F.lit("@d"), F.substring(F.sha2(F.concat(F.lit(f"{key}|domain|"), F.substring_index(low, "@", -1)), 256), 1, 20), F.lit(".example.invalid"))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
_VALID = {"iban": _is_iban, "card": _is_card}
_PIECES = "array<struct<kind: string, value: string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def _cut(piece: Column, pattern: Column, kind: Callable[[Column], Column]) -> Column:
    """The pieces that a piece without kind falls into: what matches (with its kind) and what is between."""
    between = lambda x: _piece(F.lit(None), x)
    pairs = F.zip_with(F.split(piece["value"], pattern, -1), F.regexp_extract_all(piece["value"], pattern, F.lit(0)), lambda x, v: F.when(v.isNull(), F.array(between(x))).otherwise(F.array(between(x), _piece(kind(v), v))))
    return F.flatten(pairs).cast(_PIECES)


def _open(pieces: Column, cut: Callable[[Column], Column]) -> Column:
    """pieces with those without kind cut."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNotNull(), F.array(p)).otherwise(cut(p))))


def _sized(pieces: Column, kind: str) -> Column:
    """pieces with the valid values of a kind that has sizes cut out, size by size."""

    def step(acc: Column, pattern: Column) -> Column:
        def cut(p: Column) -> Column:
            found = F.array_distinct(F.filter(F.regexp_extract_all(p["value"], pattern, F.lit(1)), _VALID[kind]))
            exact = lambda v: F.concat(F.lit(_NO_DIGIT[0] + "(?:"), F.array_join(v, "|"), F.lit(")" + _NO_DIGIT[1]))
            return _let(found, lambda v: F.when(F.size(v) == 0, F.array(p)).otherwise(_let(exact(v), lambda e: _cut(p, e, lambda _: F.lit(kind)))))

        return _open(acc, cut)

    return F.aggregate(F.array(*(F.lit(p) for p in SIZED[kind])), pieces, step)


def _matched(pieces: Column, kinds: list[Kind]) -> Column:
    """pieces with what looks like one of the kinds cut out; the kind is that of the first pattern that matches the whole value, as in the search."""
    every = "|".join(f"(?:{k.pattern})" for k in kinds)
    told = lambda v: reduce(lambda rest, k: F.when(v.rlike(f"^(?:{k.pattern})$"), F.lit(k.name)).otherwise(rest), reversed(kinds), F.lit(None).cast("string"))
    return _open(pieces, lambda p: F.when(p["value"].rlike(every), _cut(p, F.lit(every), told)).otherwise(F.array(p)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, found_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in text_col; found_col gets array<struct<kind, value, pseudonym>> of the values replaced, in order."""
    text = F.col(text_col).cast("string")
    has = text.rlike("|".join(f"(?:{p})" for p in [*(k.pattern for k in kinds), *(_ANY[k.name] for k in kinds if k.name in SIZED)]))

    def made(x: Column) -> Column:
        new = reduce(lambda rest, k: F.when(x["kind"] == k.name, _MAKERS[k.name](x["value"], key)).otherwise(rest), reversed(kinds), x["value"])
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), new.alias("pseudonym"))

    # The row goes along as one column, so that none of its names can clash with those here.
    whole = F.array(_piece(F.lit(None), F.col("_text"))).cast(_PIECES)
    staged = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"), has.alias("_has")).withColumn("_pieces", F.when(F.col("_has"), whole))
    names, groups = [k.name for k in kinds], list[list[Kind]]()
    for k in kinds:
        if groups and groups[-1][0].name not in ("email", *SIZED) and k.name not in SIZED and k.name != "phone":
            groups[-1].append(k)
        else:
            groups.append([k])
    for group in groups:
        pieces = F.col("_pieces")
        if (name := group[0].name) in SIZED:
            staged = staged.withColumn("_pieces", F.when(F.col("_has") & F.col("_text").rlike(_ANY[name]), _sized(pieces, name)).otherwise(pieces))
        # Invalid candidates are pieces too, as what looks like a card is no phone; those of IBANs wait until cards within them are out.
        if name == "iban" and "card" in names:
            continue
        group = [k for k in kinds if k.name in ("iban", "card")] if name == "card" else group
        staged = staged.withColumn("_pieces", F.when(F.col("_has"), _matched(F.col("_pieces"), group)))
    staged = staged.withColumn("_made", F.coalesce(F.transform("_pieces", made), F.array().cast("array<struct<kind: string, value: string, pseudonym: string>>")))
    new = F.when(F.size("_made") > 0, F.array_join(F.transform("_made", lambda m: m["pseudonym"]), "")).otherwise(F.col("_text"))
    columns = [new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c != found_col]
    return staged.select(*columns, *([F.filter("_made", lambda m: m["kind"].isNotNull() & (m["value"] != m["pseudonym"])).alias(found_col)] if found_col else []))
