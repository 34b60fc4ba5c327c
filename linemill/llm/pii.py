"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

Card numbers (Luhn), bank account numbers (IBAN, modulo 97), social security
numbers, telephone numbers, IPv4 addresses and dates are found by pattern,
validated, and permuted within their own format by a keyed Feistel network: a
card becomes another valid card with the same grouping, a date another date
written the same way. Equal values get equal pseudonyms in all documents, so
they stay linked, and separators are no part of a value. Mail addresses, which
are neither numbers nor dates, get a keyed address.

Defined results: null and empty texts stay as they are, and so do texts without
a valid find, byte for byte; whole texts of any length are searched; a value
may change into itself only by the chance of the permutation. Rows are treated
each on its own, other columns pass through, and an empty table gives an empty
result. Dates with slashes are read month first, and day first where that is no
date; either are permuted among themselves, so no two written dates of a form
get one pseudonym. Dates of 1900 to 2100 stay in these years, all others of the
calendar (years 0001 to 9999) out of them. Addresses with leading zeros and account numbers with check digits that no bank issues stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 10
#: First day and number of days of the dates that are permuted among each other, as a product.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 215, 340
#: Days of the calendar, and factors of a domain that just holds those outside the range above, which are permuted among each other.
CALENDAR_DAYS, OTHER_LEFT, OTHER_RIGHT = 3_652_059, 1891, 1893
#: Most steps on a cycle; two days in five lie in a month's first twelve, so a longer walk has a chance of 0.4 ** 64.
WALK = 64

#: Lengths of account numbers by country; those of other countries may have any length.
IBAN_LENGTHS = dict(
    (one[:2], int(one[2:]))
    for one in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
        "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
        "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
)
#: Characters from an account number's start that tell where it ends: 34, spaces between groups of four, and the next.
_IBAN_REACH = 43

# A place where an account number may start, with the words that may belong to it.
_IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?: [A-Z0-9]{4}(?![A-Za-z0-9])){2,7}(?: [A-Z0-9]{1,3}(?![A-Za-z0-9]))?)"
_IBAN_STARTS = rf"(?<![A-Za-z0-9])(?={_IBAN})"
# Patterns of the other kinds, tried in this order at each place.
_CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
_PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<=[ .-])\d{3}[ .-]|(?<![\d.+-])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)"
_SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
_DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
NUMBERS = "|".join((_CARD, _SSN, _DATE, _IP, _PHONE))
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,16}\p{L}{2,63}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pseudo_random(key: str, tweak: str, turn: Column, half: Column, below: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), turn.cast("string"), F.lit("|"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % below


def feistel(left: Column, right: Column, most_left: Column, most_right: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of pairs (left, right) with left < most_left and right < most_right, as a struct l, r."""

    def turn(state: Column, i: Column) -> Column:
        moved_left = (state["l"] + _pseudo_random(key, tweak, i, state["r"], most_left)) % most_left
        moved_right = (state["r"] + _pseudo_random(key, tweak, i, state["l"], most_right)) % most_right
        even = i % 2 == 0
        return F.struct(F.when(even, moved_left).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(moved_right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _permuted_index(index: Column, most_left: int, most_right: int, key: str, tweak: str) -> Column:
    moved = feistel(F.floor(index / F.lit(most_right)), index % most_right, F.lit(most_left).cast("long"), F.lit(most_right).cast("long"), key, tweak)
    return _let(moved, lambda m: m["l"] * most_right + m["r"])


def _permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permutation of the digit strings of one length, 2 to 36."""
    n = F.length(digits)
    few = F.floor(n / 2).cast("int")
    many = n - few
    most = lambda size: F.pow(F.lit(10.0), size).cast("long")
    moved = feistel(F.substr(digits, F.lit(1), few).cast("long"), F.substr(digits, few + 1, many).cast("long"), most(few), most(many), key, tweak)
    return _let(moved, lambda m: F.concat(F.lpad(m["l"].cast("string"), few, F.lit("0")), F.lpad(m["r"].cast("string"), many, F.lit("0"))))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    chars = F.array_remove(F.split(form, ""), "")

    def with_digits(known: Column) -> Column:
        def put(state: Column, one: Column) -> Column:
            digit = one.rlike("^[0-9]$")
            return F.struct(F.concat(state["out"], F.when(digit, F.substr(known, state["at"], F.lit(1))).otherwise(one)).alias("out"), (state["at"] + digit.cast("int")).alias("at"))

        return F.aggregate(chars, start, put, lambda s: s["out"])

    return _let(digits, with_digits)


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; doubled_first if the last digit counts double."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = (i % 2 == (0 if doubled_first else 1)).cast("int")
        value = digit * (twice + 1)
        return total + F.when(value > 9, value - 9).otherwise(value)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _modulo_97(value: Column) -> Column:
    """Value of a string of digits and capital letters, modulo 97, letters counting 10 to 35."""

    def add(rest: Column, one: Column) -> Column:
        number = F.when(one.rlike("^[0-9]$"), one.cast("int")).otherwise(F.ascii(one) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.array_remove(F.split(value, ""), ""), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    digits = _only_digits(value)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    checked = lambda moved: F.concat(moved, ((10 - _luhn_sum(moved, True) % 10) % 10).cast("string"))
    return F.when(_luhn_sum(digits, False) % 10 == 0, _filled(value, _let(_permuted_digits(payload, key, "card"), checked))).otherwise(value)


def _iban_country(value: Column) -> Column:
    return F.substr(value, F.lit(1), F.lit(2))


def _iban_valid(value: Column) -> Column:
    """Whether the length is the country's and the check digits are right."""

    def checked(flat: Column) -> Column:
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        known = F.try_element_at(lengths, _iban_country(flat))
        turned = F.concat(F.substr(flat, F.lit(5), F.length(flat) - 4), F.substr(flat, F.lit(1), F.lit(4)))
        check = F.substr(flat, F.lit(3), F.lit(2)).cast("int")
        return F.coalesce(known == F.length(flat), F.lit(True)) & check.between(2, 98) & (_modulo_97(turned) == 1)

    return _let(F.regexp_replace(value, " ", ""), checked)


def _iban_at_start(text: Column) -> Column:
    """The valid account number that text starts with, of several the longest; null if there is none."""

    def longest(words: Column) -> Column:
        sizes = F.sequence(F.size(words), F.least(F.size(words), F.lit(3)), F.lit(-1))
        return F.get(F.filter(F.transform(sizes, lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")), _iban_valid), F.lit(0))

    return _let(F.regexp_extract(text, f"^{_IBAN}", 0), lambda found: F.when(found != "", _let(F.split(found, " "), longest)))


def _iban(value: Column, key: str) -> Column:
    """Pseudonym of a valid account number."""
    flat = F.regexp_replace(value, " ", "")
    country, account = _iban_country(flat), F.substr(flat, F.lit(5), F.length(flat) - 4)
    digits = _only_digits(account)
    moved = F.when(F.length(digits) >= 2, _filled(account, _permuted_digits(digits, key, "iban"))).otherwise(account)
    check = lambda m: F.lpad((98 - _modulo_97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0")
    return _filled(value, _let(moved, lambda m: _only_digits(F.concat(check(m), m))))


def _social(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = _permuted_index(place * 989901 + (group - 1) * 9999 + (serial - 1), 898, 989901, key, "social")

    def written(m: Column) -> Column:
        new_place, rest = F.floor(m / F.lit(989901)), m % 989901
        new_area = F.when(new_place >= 665, new_place + 2).otherwise(new_place + 1)
        return F.format_string("%03d-%02d-%04d", new_area, F.floor(rest / F.lit(9999)) + 1, rest % 9999 + 1)

    return _let(moved, written)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits of a national number (all but two of another) change; the country's stay."""
    digits = _only_digits(value)
    stays = F.when(value.rlike(r"^\+\d+$"), 2).otherwise(F.length(digits) - 10)
    head = F.substr(digits, F.lit(1), stays)
    return _filled(value, F.concat(head, _permuted_digits(F.substr(digits, stays + 1, F.length(digits) - stays), key, "phone")))


def _address(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    octet = [part[i].cast("long") for i in range(4)]
    moved = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    return _let(moved, lambda m: F.concat_ws(".", *[x.cast("string") for half in ("l", "r") for x in (F.floor(m[half] / 256), m[half] % 256)]))


def _moved_day(index: Column, key: str) -> Column:
    return _permuted_index(index, DAYS_LEFT, DAYS_RIGHT, key, "date")


def _day(index: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), index.cast("int"))


def _moved_other(index: Column, key: str) -> Column:
    return _permuted_index(index, OTHER_LEFT, OTHER_RIGHT, key, "other date")


def _other_day(index: Column) -> Column:
    """The index-th day of the calendar that is not among the DAYS_LEFT * DAYS_RIGHT from FIRST_DAY on."""
    before = F.datediff(F.lit(FIRST_DAY).cast("date"), F.lit("0001-01-01").cast("date"))
    return F.date_add(F.lit("0001-01-01").cast("date"), F.when(index < before, index).otherwise(index + DAYS_LEFT * DAYS_RIGHT).cast("int"))


def _walked(index: Column, moved: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """The next fitting index on the cycle of a permutation, which so permutes the fitting ones."""
    step = lambda state, _: F.when(fits(state), state).otherwise(moved(state))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(index), step)


def _new_day(index: Column, key: str, late: bool) -> Column:
    """The day for the index-th day from FIRST_DAY on; of late days, those after a month's twelfth, another late one."""
    if not late:
        return _day(_moved_day(index, key))
    return _day(_walked(index, lambda i: _moved_day(i, key), lambda i: F.dayofmonth(_day(i)) > 12))


def _new_other_day(index: Column, key: str, late: bool) -> Column:
    others = CALENDAR_DAYS - DAYS_LEFT * DAYS_RIGHT
    # A day outside the domain is never made: least keeps the dates' arithmetic in the calendar.
    fits = lambda i: (i < others) & (F.lit(not late) | (F.dayofmonth(_other_day(F.least(i, F.lit(others - 1)))) > 12))
    return _other_day(_walked(index, lambda i: _moved_other(i, key), fits))


def _date(value: Column, key: str) -> Column:
    """Pseudonym of a date written in one of four forms; month-first and day-first dates are permuted among their own."""
    out, span = value, DAYS_LEFT * DAYS_RIGHT
    for form, late in (("dd/MM/yyyy", True), ("MM/dd/yyyy", False), ("dd.MM.yyyy", False), ("yyyy-MM-dd", False)):
        shape = form.replace("dd", r"\d{2}").replace("MM", r"\d{2}").replace("yyyy", r"\d{4}").replace(".", r"\.")
        day = F.try_to_date(value, form)
        index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        place = F.datediff(day, F.lit("0001-01-01").cast("date")).cast("long")
        new = F.when(index.between(0, span - 1), _new_day(index, key, late)).otherwise(_new_other_day(F.when(index < 0, place).otherwise(place - span), key, late))
        # The later form wins, so a date that has a month-first reading is month first.
        out = F.when(value.rlike(f"^{shape}$") & (place >= 0), F.date_format(new, form)).otherwise(out)
    return out


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one find of NUMBERS, or the find itself if it is not valid."""
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}([/.])\d{2}\1\d{4}$"), _date(value, key))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _social(value, key))
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _address(value, key))
        .when(value.rlike(r"^\d{13}|^\d{4}[ -]"), _card(value, key))
        .otherwise(_phone(value, key))
    )


def mail_pseudonym(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(value)), 256)
    letters = F.translate(F.substring(digest, 1, 16), "0123456789", "ghijklmnop")
    return F.concat(letters, F.lit("@mail.invalid"))


def _replaced(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """text with each find of pattern replaced by a function of it."""
    gaps = F.split(text, pattern, -1)
    finds = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.concat(F.transform(finds, new), F.array(F.lit(""))), lambda gap, put: F.concat(gap, put)), "")


def _numbers_replaced(text: Column, key: str) -> Column:
    return _replaced(text, NUMBERS, lambda value: pseudonym(value, key))


def _with_ibans(text: Column, key: str) -> Column:
    """text with account numbers replaced, and other numbers between them.

    It is cut where an account number may start; only cuts before valid ones
    outside of one another stay, so what is refused is searched as other text.
    """

    def of_pieces(pieces: Column) -> Column:
        between = lambda a, b: F.array_join(F.slice(pieces, a, b - a), "")
        at = F.sequence(F.lit(1), F.size(pieces))
        reach = lambda i: F.substr(F.array_join(F.transform(F.slice(pieces, i, F.lit(_IBAN_REACH)), lambda p: F.substr(p, F.lit(1), F.lit(_IBAN_REACH))), ""), F.lit(1), F.lit(_IBAN_REACH))
        valid = F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), _iban_at_start(reach(i)).alias("iban"))), lambda v: v["iban"].isNotNull())

        def add(kept: Column, v: Column) -> Column:
            last = F.get(kept, F.size(kept) - 1)
            return F.when(F.length(between(last["at"], v["at"])) >= F.length(last["iban"]), F.concat(kept, F.array(v))).otherwise(kept)

        head = F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("iban")))

        def of_kept(kept: Column) -> Column:
            def put(v: Column, i: Column) -> Column:
                end = F.coalesce(F.get(kept, i + 1)["at"], F.size(pieces) + 1)
                rest = _let(between(v["at"], end), lambda t: F.substr(t, F.length(v["iban"]) + 1, F.length(t)))
                return F.concat(F.when(v["iban"] == "", "").otherwise(_iban(v["iban"], key)), _numbers_replaced(rest, key))

            return F.array_join(F.transform(kept, put), "")

        return _let(F.aggregate(valid, head, add), of_kept)

    return _let(F.split(text, _IBAN_STARTS, -1), of_pieces)


def pseudonymised(text: Column, key: str) -> Column:
    """A text's pseudonymised form; texts without a digit or an at sign are not searched."""
    mailed = F.when(F.contains(text, F.lit("@")), _replaced(text, MAIL, lambda m: mail_pseudonym(m, key))).otherwise(text)
    # A mail address's own digits are gone or keyed by now, and its pseudonym has no pattern of a number.
    digits = mailed.rlike("[0-9]")
    with_ibans = _let(mailed, lambda t: _with_ibans(t, key))
    return F.when(digits & mailed.rlike(_IBAN_STARTS), with_ibans).when(digits & mailed.rlike(NUMBERS), _numbers_replaced(mailed, key)).otherwise(mailed)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text pseudonymised under a secret key; all columns keep their names."""
    return docs.withColumn(text, pseudonymised(F.col(f"`{text}`"), key))
