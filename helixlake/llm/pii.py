"""Format-preserving Feistel pseudonyms for personal data.

Card, phone, social security, bank account and IPv4 numbers, dates and the local parts of e-mail
addresses are found by one pattern, validated (checksums, ranges, the calendar), and replaced by the
value that a keyed permutation of their format's domain gives them. A permutation keeps distinct
values distinct and equal ones equal, so values stay linked across documents; the same key undoes it.
Built-in functions only; each row is rewritten by itself.

Defined results: a null text stays null; values that fail validation stay as they are; repeated rows
get equal results; digits keep their separators, so one number in two spellings stays one number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import let, positions

KINDS = ("email", "phone", "iban", "ip", "date", "ssn", "card")
ROUNDS = 8
#: Numbers that a card's permutation may go on to; each is refused with a chance of 0.5 at most.
WALK = 64

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
# Cards and phones stop where a value of another shape starts. The shapes alone tell where matches end, and
# they stay under the permutations, so that the same values are found on the way back.
_AMEX = [f"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}(?![0-9])" for s in " -"]
_QUAD = [f"[0-9]{{4}}(?:{s}[0-9]{{4}}(?![0-9])){{3}}" for s in " -"]
_WHOLE = r"[0-9]{13,19}(?![0-9])"
_SHAPES = "|".join((_WHOLE, *_AMEX, *_QUAD))
_OTHER = "|".join((r"[A-Za-z0-9._%+-]++@", IP, DATE, SSN))
_BLANK = f" (?!{_OTHER}|{_SHAPES})"
#: Groups of four with one separator, as many as follow each other, and a short last one.
CHAIN = "|".join(
    f"{_QUAD[k]}(?:{s}(?!{_OTHER}|{'|'.join(_AMEX)}|{_QUAD[1 - k]})[0-9]{{4}}(?![0-9]))*+(?:{s}(?!{_OTHER})[0-9]{{1,3}}(?![0-9]))?"
    for k, s in enumerate(" -")
)
_GROUPS = f"[0-9](?:(?:{_BLANK}|-(?!{_SHAPES}))?[0-9]){{12,18}}(?![0-9])"
CARD = f"(?<![0-9])(?:{'|'.join((_WHOLE, *_AMEX, CHAIN, _GROUPS))})"
# groups of four that go on further may have begun with the phone's own
_BLANK = f" (?!{_OTHER}|{_WHOLE}|{'|'.join(_AMEX)}|{'|'.join(f'{q}(?!{s}[0-9]{{4}}(?![0-9]))' for q, s in zip(_QUAD, ' -', strict=True))})"
#: North American numbers, then those with one kind of separator, then with several; 8 to 15 digits.
PHONE = "|".join((
    rf"\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])",
    rf"\+[0-9](?:(?:{_BLANK})?\(?[0-9]\)?){{7,14}}(?![0-9]|[.,:/-][0-9])",
    r"\+[0-9](?:-?\(?[0-9]\)?){7,14}(?![0-9])",
    r"\+[0-9](?:\.?\(?[0-9]\)?){7,14}(?![0-9])",
    rf"\+[0-9](?:(?:{_BLANK}|[.-])?\(?[0-9]\)?){{7,14}}(?![0-9])",
))
#: Alternatives in this order; what was found tells its kind by ``kind_of``.
PATTERN = "|".join((EMAIL, PHONE, IBAN, IP, DATE, SSN, CARD))

#: The calendar repeats after 400 years, which have 27 * 7 * 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1700-01-01", 189, 773

_YEARS = range(1700, 2100)
_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Dates that can only be read day first: days and years that go together.
DAYS_FIRST = ([f"{d:02}/{m:02}" for m, n in enumerate(_LENGTHS, 1) for d in range(13, n + 1)], [str(y) for y in _YEARS])
LEAP_DAYS = (["29/02"], [str(y) for y in _YEARS if y % 4 == 0 and (y % 100 or y % 400 == 0)])


def _noise(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 bits keyed on the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def permuted(x: Column, y: Column, a: Column | int, b: Column | int, key: str, kind: str, undo: bool = False) -> Column:
    """struct<x,y>: a keyed permutation of the pairs (x < a, y < b), by an unbalanced Feistel network."""
    a, b = (m.cast("bigint") if isinstance(m, Column) else F.lit(m).cast("bigint") for m in (a, b))
    sign = -1 if undo else 1

    def turn(s: Column, r: Column) -> Column:
        left = F.pmod(s["x"] + sign * _noise(key, kind, r, s["y"]), a)
        right = F.pmod(s["y"] + sign * _noise(key, kind, r, s["x"]), b)
        return F.when(r % 2 == 1, F.struct(left.alias("x"), s["y"].alias("y"))).otherwise(F.struct(s["x"].alias("x"), right.alias("y")))

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(order, F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _part(digits: Column, start: Column | int, length: Column | int) -> Column:
    """Digits as a number; no digits are 0."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(F.lit("0"), F.substr(digits, lit(start), lit(length))).cast("bigint")


def _padded(value: Column, length: Column | int) -> Column:
    size = length if isinstance(length, Column) else F.lit(length)
    return F.lpad(value.cast("string"), size, F.lit("0"))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    return F.array_join(
        F.transform(
            F.split(shape, ""),
            lambda ch, k: F.when(F.rlike(ch, F.lit("[0-9]")), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), k + 1))), F.lit(1))).otherwise(ch),
        ),
        "",
    )


def _halves(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """A keyed permutation of all digit strings of one length (18 at most)."""

    def made(n: Column) -> Column:
        h = F.floor(n / 2).cast("int")
        pair = permuted(_part(digits, 1, h), _part(digits, h + 1, n - h), F.pow(F.lit(10), h), F.pow(F.lit(10), n - h), key, kind, undo)
        return let(pair, lambda p: F.concat(F.when(h > 0, _padded(p["x"], h)).otherwise(""), _padded(p["y"], n - h)))

    return let(F.length(digits), made)


def luhn_sum(digits: Column, odd_from_right: int) -> Column:
    """Luhn sum of a digit string; digits at odd places from the right count double if ``odd_from_right``
    is 1 (a whole number), at even places if it is 0 (a number that its check digit will follow)."""

    def place(d: Column, k: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(k % 2 == odd_from_right, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), place), F.lit(0), lambda n, d: n + d)


def _valid(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0)


def _card(digits: Column, key: str, undo: bool) -> Column:
    """A card number under the permutation of those of its length and first digit."""
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _halves(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card", undo))
    return let(body, lambda c: F.concat(c, F.pmod(-luhn_sum(c, 0), F.lit(10)).cast("string")))


def _cards(value: Column, key: str, undo: bool) -> Column:
    """array<struct<old,new>>: a match of CARD in pieces, the cards in it and what lies between them.

    In groups of four any four, or four and the short one, can be a card; else the first groups. Of those
    with a right check digit the one that ends first is taken. So what was tried in vain before it lies
    in it and the groups before; the permutation goes on to the next number until all of that fails again,
    and the way back takes the same groups.
    """
    quads = F.rlike(value, F.lit(f"^(?:{CHAIN})$"))
    piece = lambda old, new: F.struct(old.alias("old"), new.alias("new"))

    def tried(ws: Column) -> Column:
        """(first digit, digits) of what could have been a card before the last group."""
        of_four = F.transform(positions(F.lit(0), F.size(ws) - 5), lambda i: F.struct((i * 4 + 1).alias("at"), F.lit(16).alias("n")))
        first = F.transform(positions(F.lit(1), F.size(ws) - 1), lambda i: F.struct(F.lit(1).alias("at"), F.length(_digits(F.array_join(F.slice(ws, 1, i), ""))).alias("n")))
        return F.when(quads, of_four).otherwise(first)

    def replaced(before: Column, own: Column, others: Column) -> Column:
        def fails(d: Column) -> Column:
            return ~F.exists(others, lambda w: _valid(F.substr(F.concat(_digits(before), d), w["at"], w["n"])))

        def turn(s: Column, _: Column) -> Column:
            return F.when(s["done"], s).otherwise(let(_card(s["d"], key, undo), lambda d: F.struct(d.alias("d"), fails(d).alias("done"))))

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(_digits(own).alias("d"), F.lit(False).alias("done")), turn)
        body = F.regexp_replace(own, "^[ -]", "")
        gap = F.concat(before, F.regexp_extract(own, "^[ -]?", 0))
        return F.array(piece(gap, gap), piece(body, _refilled(body, walked["d"])))

    def judged(s: Column, ws: Column) -> Column:
        size = F.size(ws)
        k = F.when(quads, F.when(F.length(_digits(F.element_at(ws, -1))) < 4, 5).otherwise(4)).otherwise(size)
        own = F.when(size >= k, F.array_join(F.slice(ws, F.greatest(size - k + 1, F.lit(1)), k), ""))

        def chosen(own: Column) -> Column:
            before = F.array_join(F.slice(ws, 1, F.greatest(size - k, F.lit(0))), "")
            first = F.element_at(ws, 1)
            return (
                F.when(
                    F.coalesce(_valid(_digits(own)), F.lit(False)),
                    F.struct(F.concat(s["parts"], let(tried(ws), lambda o: replaced(before, own, o))).alias("parts"), none.alias("wait")),
                )
                .when(quads & (size >= 8), F.struct(F.concat(s["parts"], F.array(piece(first, first))).alias("parts"), F.slice(ws, 2, 7).alias("wait")))
                .otherwise(F.struct(s["parts"].alias("parts"), ws.alias("wait")))
            )

        return let(own, chosen)

    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<old:string,new:string>>").alias("parts"), none.alias("wait"))
    groups = F.regexp_extract_all(value, F.lit("[ -]?[0-9]+"), F.lit(0))
    step = lambda s, g: let(F.concat(s["wait"], F.array(g)), lambda ws: judged(s, ws))
    rest = lambda s: let(F.array_join(s["wait"], ""), lambda r: F.concat(s["parts"], F.array(piece(r, r))))
    return F.aggregate(groups, start, step, rest)


def _phone(value: Column, key: str, undo: bool) -> Column:
    """North American numbers stay in their numbering plan; others keep their first two digits."""

    def american(d: Column) -> Column:
        x = (_part(d, 2, 3) - 200) * 800 + _part(d, 5, 3) - 200
        pair = permuted(x, _part(d, 8, 4), 640_000, 10_000, key, "phone", undo)
        return let(pair, lambda p: F.concat(F.lit("1"), (F.floor(p["x"] / 800) + 200).cast("string"), (p["x"] % 800 + 200).cast("string"), _padded(p["y"], 4)))

    def made(d: Column) -> Column:
        other = F.concat(F.substr(d, F.lit(1), F.lit(2)), _halves(F.substr(d, F.lit(3)), key, "phone", undo))
        new = F.when(F.rlike(d, F.lit("^1[2-9][0-9]{2}[2-9][0-9]{6}$")), american(d)).otherwise(other)
        return _refilled(value, new)

    return let(_digits(value), made)


def _ip(value: Column, key: str, undo: bool) -> Column:
    def made(o: Column) -> Column:
        pair = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, key, "ip", undo)
        return let(pair, lambda p: F.concat_ws(".", *[v.cast("bigint").cast("string") for v in (F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)]))

    octets = F.transform(F.split(value, r"\."), lambda v: v.cast("int"))
    return let(octets, lambda o: F.when(F.array_max(o) <= 255, made(o)).otherwise(value))


def _date(value: Column, key: str, undo: bool) -> Column:
    """Slashes: month before day; where only the other order is a date, the result is such a date too."""
    out = value
    for shape, form in ((r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{4}-", "yyyy-MM-dd")):
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.to_date(F.lit(FIRST_DAY)))
        ok = F.rlike(value, F.lit(shape)) & day.between(0, DAYS_A * DAYS_B - 1)
        pair = permuted(F.floor(day / DAYS_B), day % DAYS_B, DAYS_A, DAYS_B, key, "date", undo)
        new = let(pair, lambda p: p["x"] * DAYS_B + p["y"])
        out = F.when(F.coalesce(ok, F.lit(False)), F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), new.cast("int")), form)).otherwise(out)
    for days, years in (DAYS_FIRST, LEAP_DAYS):
        day_list, year_list = (F.array(*[F.lit(v) for v in values]) for values in (days, years))
        x = F.array_position(day_list, F.substr(value, F.lit(1), F.lit(5))) - 1
        y = F.array_position(year_list, F.substr(value, F.lit(7))) - 1
        pair = permuted(x, y, len(days), len(years), key, "date", undo)
        new = let(pair, lambda p: F.concat(F.get(day_list, p["x"].cast("int")), F.lit("/"), F.get(year_list, p["y"].cast("int"))))  # noqa: B023
        out = F.when((x >= 0) & (y >= 0), new).otherwise(out)
    return out


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""

    def made(d: Column) -> Column:
        area, group, serial = _part(d, 1, 3), _part(d, 4, 2), _part(d, 6, 4)
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        x = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = permuted(x, (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, key, "ssn", undo)

        def shown(p: Column) -> Column:
            new = F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1)
            return F.concat(_padded(new, 3), _padded(F.floor(p["y"] / 9_999) + 1, 2), _padded(p["y"] % 9_999 + 1, 4))

        return F.when(ok, _refilled(value, let(pair, shown))).otherwise(value)

    return let(_digits(value), made)


def _mod97(value: Column) -> Column:
    """Remainder of an account number whose letters count as 10 to 35."""
    numbers = F.transform(F.split(value, ""), lambda ch: F.conv(ch, 36, 10).cast("bigint"))
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda n, d: (n * F.when(d > 9, F.lit(100)).otherwise(F.lit(10)) + d) % 97)


def _iban(value: Column, key: str, undo: bool) -> Column:
    land, account = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(5))
    ok = _mod97(F.concat(account, F.substr(value, F.lit(1), F.lit(4)))) == 1

    def made(new: Column) -> Column:
        check = 98 - _mod97(F.concat(new, land, F.lit("00")))
        return F.concat(land, _padded(check, 2), new)

    return F.when(ok, let(_letters(account, key, "iban", undo), made)).otherwise(value)


def _shifted(part: Column, other: Column, turn: int, key: str, kind: str, sign: int) -> Column:
    """Letters and digits moved within their own class by a keyed stream of the other part."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(turn)), F.length(part).cast("string"), F.lower(other)).cast("binary"), 512)

    def moved(stream: Column) -> Column:
        def one(ch: Column, k: Column) -> Column:
            noise = F.conv(F.substr(stream, (k % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
            code = F.ascii(ch)
            return (
                F.when(code.between(48, 57), F.char(F.pmod(code - 48 + noise, F.lit(10)) + 48))
                .when(code.between(97, 122), F.char(F.pmod(code - 97 + noise, F.lit(26)) + 97))
                .when(code.between(65, 90), F.char(F.pmod(code - 65 + noise, F.lit(26)) + 65))
                .otherwise(ch)
            )

        return F.array_join(F.transform(F.split(part, ""), one), "")

    return let(stream, moved)


def _letters(value: Column, key: str, kind: str, undo: bool) -> Column:
    """A keyed permutation of the strings with the same class of character at every place."""
    h = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substr(value, F.lit(1), h).alias("x"), F.substr(value, h + 1).alias("y"))
    sign = -1 if undo else 1

    def step(s: Column, r: int) -> Column:
        if r % 2:
            return let(s, lambda p: F.struct(p["x"].alias("x"), _shifted(p["y"], p["x"], r, key, kind, sign).alias("y")))
        return let(s, lambda p: F.struct(_shifted(p["x"], p["y"], r, key, kind, sign).alias("x"), p["y"].alias("y")))

    turns = range(1, ROUNDS + 1)
    return let(reduce(step, reversed(turns) if undo else turns, state), lambda p: F.concat(p["x"], p["y"]))


def _email(value: Column, key: str, undo: bool) -> Column:
    at = F.instr(value, F.lit("@"))
    return F.concat(_letters(F.substr(value, F.lit(1), at - 1), key, "email", undo), F.substr(value, at))


def kind_of(value: Column) -> Column:
    """The kind of a match of PATTERN, by its shape."""
    whole = lambda p: F.rlike(value, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.startswith(value, F.lit("+")), "phone")
        .when(F.rlike(value, F.lit("^[A-Z]")), "iban")
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "ip")
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), "date")
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .otherwise("card")
    )


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """array<struct<kind,old,new>>: a found value, in pieces, under the keyed permutation of its kind (or back)."""
    makers = {"email": _email, "phone": _phone, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn}

    def piece(kind: Column, old: Column, new: Column) -> Column:
        return F.struct(kind.alias("kind"), old.alias("old"), new.alias("new"))

    def chosen(kind: Column) -> Column:
        out = value
        for name, make in makers.items():
            out = F.when(kind == name, make(value, key, undo)).otherwise(out)
        cards = F.transform(_cards(value, key, undo), lambda p: piece(kind, p["old"], p["new"]))
        return F.when(kind == "card", cards).otherwise(F.array(piece(kind, value, out)))

    return let(kind_of(value), chosen)


def pseudonymised(df: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """``df`` with its texts rewritten, and ``found array<struct<kind,old,new>>`` of what was changed, which replaces a
    column of that name; all others stay as they are."""
    value = df[text].cast("string")
    kind = "array<array<struct<kind:string,old:string,new:string>>>"
    matches = F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0))
    made = F.transform(matches, lambda m: pseudonym(m, key, undo))
    found = F.when(F.rlike(value, F.lit(PATTERN)), made.cast(kind)).otherwise(F.array().cast(kind))

    def rebuilt(fs: Column) -> Column:
        pairs = F.zip_with(F.split(value, PATTERN, -1), fs, lambda gap, f: F.concat(gap, F.coalesce(F.array_join(F.transform(f, lambda p: p["new"]), ""), F.lit(""))))
        return F.struct(
            F.when(F.size(fs) > 0, F.array_join(pairs, "")).otherwise(value).alias("text"),
            F.filter(F.flatten(fs), lambda f: f["old"] != f["new"]).alias("found"),
        )

    one = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), let(found, rebuilt).alias("made"))
    kept = [(F.col("made.text") if c == text else F.col("row")[c]).alias(c) for c in df.columns if c == text or c.lower() != "found"]
    return one.select(*kept, F.col("made.found").alias("found"))


def n_found(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
