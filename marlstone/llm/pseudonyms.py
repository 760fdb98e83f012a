"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One pattern finds candidates; each is validated by its kind (Luhn for cards, mod 97 for account numbers,
octets for addresses, the calendar for dates, area rules for social security numbers) and, if valid,
replaced by a keyed Feistel permutation of itself within its format. A permutation is one to one: equal
values get equal pseudonyms in every document, different values stay different, and with the key
restore() gives the originals back. Pseudonyms of cards and account numbers pass the same checks.

Kept as they are: separators, country codes, the domain of an e-mail address and letters beyond ASCII before it, the name
before a secret's "=", and every candidate that is not valid.

Defined cases: null text stays null, an empty one empty; repeated rows are treated alike; texts of any length are
scanned whole; an empty table gives no rows; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of the registered query, on made-up personal data only: whoever knows the key can undo the pseudonyms.
DEMO_KEY = "change-me"
ROUNDS = 8
#: Days from 0001-01-01 to 9999-12-31, as a product of two numbers of like size.
DAYS_A, DAYS_B = 2127, 1717
#: Longest half, in characters, that one Feistel step adds up as a number.
CHUNK = 9

#: Fixed patterns of the kinds, each tried in this order at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?)[0-9A-Za-z_+/-]{12,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ -][0-9])?(?:[ -][0-9]{2,4}){2,4}(?!\w|[.-][0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\w])|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "card": r"(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w])",
}
#: Card numbers by the form of their groups, inside a run of digits that is not one number.
CARD_UNIT = r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
#: Each turn more than one is needed for a tenth of the numbers that needed the one before.
CARD_TURNS = 12
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"


def once(value: Column, f) -> Column:
    """f(value) with value computed one time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _draw(key: str, kind: str, k: int, other: Column, size: Column, tweak: Column) -> Column:
    """A number below size that depends on the key, the step, the other half and the tweak."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(k)), other.cast("string"), tweak), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)


def _feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column, inverse: bool, tweak: Column | None = None) -> Column:
    """struct(l, r): a permutation of the pairs (left below a, right below b), another one for each tweak."""
    tweak = F.lit("") if tweak is None else tweak
    state = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    sign = -1 if inverse else 1

    def on_left(k: int):
        return lambda s: F.struct(F.pmod(s["l"] + sign * _draw(key, kind, k, s["r"], a, tweak), a).alias("l"), s["r"].alias("r"))

    def on_right(k: int):
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * _draw(key, kind, k, s["l"], b, tweak), b).alias("r"))

    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        state = once(state, on_right(k) if k % 2 else on_left(k))
    return state


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i) for i in range(CHUNK + 1)]), n + 1)


def _permuted(key: str, kind: str, s: Column, inverse: bool, letters: str) -> Column:
    """A permutation of the strings of one length over some letters (36 at most). Up to 2 * CHUNK letters are two halves;
    longer strings are cut into such blocks, each permuted under the plain letters of the blocks before it."""
    base = len(letters)
    figures = ("0123456789" + LETTERS)[:base]

    def number(x: Column) -> Column:
        return F.when(x == "", F.lit(0)).otherwise(F.conv(F.translate(x, letters, figures), base, 10).try_cast("bigint"))

    def text(n: Column, k: Column) -> Column:
        return F.when(k > 0, F.lpad(F.translate(F.lower(F.conv(n.cast("string"), 10, base)), figures, letters), k, letters[0])).otherwise("")

    def block(so_far: Column, i: Column) -> Column:
        def two(x: Column) -> Column:
            n = F.length(x)
            h = F.floor(n / 2).cast("int")
            out = _feistel(key, kind, number(F.substr(x, F.lit(1), h)), number(F.substr(x, h + 1)), _power(base, h), _power(base, n - h), inverse, so_far["plain"])
            done = once(out, lambda o: F.concat(text(o["l"], h), text(o["r"], n - h)))
            return once(done, lambda d: F.struct(F.concat(so_far["done"], d).alias("done"), F.concat(so_far["plain"], d if inverse else x).alias("plain")))

        return once(F.substr(s, i * 2 * CHUNK + 1, F.lit(2 * CHUNK)), two)

    first = F.struct(F.lit("").alias("done"), F.lit("").alias("plain"))
    count = F.floor((F.length(s) - 1) / (2 * CHUNK)).cast("int")
    return F.when(F.length(s) == 0, s).otherwise(F.aggregate(F.sequence(F.lit(0), count), first, block, lambda o: o["done"]))


def _digits(key: str, kind: str, s: Column, inverse: bool) -> Column:
    return _permuted(key, kind, s, inverse, HEX[:10])


def _letters(key: str, kind: str, s: Column, inverse: bool, letters: str = LETTERS) -> Column:
    return _permuted(key, kind, s, inverse, letters)


def _weave(shape: Column, digits: Column, letters: Column) -> Column:
    """The characters of shape with its digits and letters replaced in order; case and other signs stay."""
    first = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("a"))

    def put(s: Column, c: Column) -> Column:
        letter = F.substr(letters, s["a"], F.lit(1))
        is_d, upper, lower = c.rlike("^[0-9]$"), c.rlike("^[A-Z]$"), c.rlike("^[a-z]$")
        new = F.when(is_d, F.substr(digits, s["d"], F.lit(1))).when(upper, F.upper(letter)).when(lower, letter).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["d"] + is_d.cast("int")).alias("d"),
                        (s["a"] + (upper | lower).cast("int")).alias("a"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), first, put, lambda s: s["out"])


def _only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def _mixed(key: str, kind: str, s: Column, inverse: bool) -> Column:
    """Digits among digits and letters among letters, at their places."""
    return once(
        F.struct(_digits(key, kind, _only(s, "0-9"), inverse).alias("d"),
                 _letters(key, kind, F.lower(_only(s, "A-Za-z")), inverse).alias("a")),
        lambda x: _weave(s, x["d"], x["a"]))


def _secret(key: str, s: Column, inverse: bool) -> Column:
    return F.when(s.rlike("^[0-9a-f]+$"), _letters(key, "hex", s, inverse, HEX)).otherwise(_mixed(key, "secret", s, inverse))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(
        c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _card(key: str, s: Column, inverse: bool) -> Column:
    """A run that fails its check digit as a whole is judged by the units in it. Their places depend on the form alone, and
    units are turned on while the run as a whole would pass, so that restore() takes the same way."""

    def one(x: Column) -> Column:
        def run(d: Column) -> Column:
            body = once(_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), inverse), lambda b: F.concat(
                b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
            return F.when(luhn_sum(d) % 10 == 0, _weave(x, body, F.lit(""))).otherwise(x)

        return once(_only(x, "0-9"), run)

    def passes(x: Column) -> Column:
        return luhn_sum(_only(x, "0-9")) % 10 == 0

    def units(x: Column) -> Column:
        new = F.transform(F.regexp_extract_all(x, F.lit(CARD_UNIT), F.lit(0)), one)
        return F.array_join(F.zip_with(F.split(x, CARD_UNIT, -1), new, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")

    turned = F.aggregate(F.sequence(F.lit(1), F.lit(CARD_TURNS)), s, lambda x, k: F.when((k == 1) | passes(x), units(x)).otherwise(x))
    return F.when(passes(s), one(s)).when(s.rlike(CARD_UNIT), turned).otherwise(s)


def _iban(key: str, s: Column, inverse: bool) -> Column:
    def run(p: Column) -> Column:
        country, rest = F.substr(p, F.lit(1), F.lit(2)), F.substr(p, F.lit(5))
        valid = _mod97(F.concat(rest, F.substr(p, F.lit(1), F.lit(4)))) == 1
        new = once(_mixed(key, "iban", rest, inverse), lambda r: F.concat(
            country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
        return F.when(valid, once(new, lambda n: _weave(
            s, _only(n, "0-9"), F.lower(_only(n, "A-Z"))))).otherwise(s)

    return once(F.replace(s, F.lit(" "), F.lit("")), run)


def _ip(key: str, s: Column, inverse: bool) -> Column:
    def run(o: Column) -> Column:
        n = lambda i: F.get(o, i).cast("int")
        valid = F.forall(o, lambda x: x.cast("int") <= 255)
        out = _feistel(key, "ip", n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(1 << 16), F.lit(1 << 16), inverse)
        text = once(out, lambda x: F.concat_ws(".", *[
            (F.floor(x[h] / 256) if k == 0 else x[h] % 256).cast("string") for h in "lr" for k in (0, 1)]))
        return F.when(valid, text).otherwise(s)

    return once(F.split(s, r"\."), run)


def _date(key: str, s: Column, inverse: bool) -> Column:
    iso = s.rlike("^[0-9]{4}-")
    mark = F.substr(s, F.lit(3), F.lit(1))
    text = F.when(iso, s).otherwise(F.concat_ws("-", F.substr(s, F.lit(7), F.lit(4)), F.substr(s, F.lit(4), F.lit(2)), F.substr(s, F.lit(1), F.lit(2))))
    day = F.when(F.substr(text, F.lit(1), F.lit(4)) != "0000", text.try_cast("date"))
    origin = F.make_date(F.lit(1), F.lit(1), F.lit(1))

    def run(n: Column) -> Column:
        out = _feistel(key, "date", F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), inverse)

        def write(d: Column) -> Column:
            y, m, dd = F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")
            return F.when(iso, F.concat_ws("-", y, m, dd)).otherwise(F.concat(dd, mark, m, mark, y))

        new = once(out, lambda x: F.date_add(origin, (x["l"] * DAYS_B + x["r"]).cast("int")))
        return F.when(n.isNull(), s).otherwise(once(new, write))

    return once(F.datediff(day, origin), run)


def _ssn(key: str, s: Column, inverse: bool) -> Column:
    """Areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999: each part keeps to its range."""
    area, group, serial = (F.substr(s, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - (area > 666).cast("int")
    out = _feistel(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), inverse)

    def write(x: Column) -> Column:
        a = x["l"] + 1 + (x["l"] >= 665).cast("int")
        parts = (a, 3), (F.floor(x["r"] / 9999) + 1, 2), (x["r"] % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.when(valid, once(out, write)).otherwise(s)


def kind_of(match: Column) -> Column:
    """The kind of a match of PATTERN, by the form of the whole match."""
    bare = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        bare = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(bare)
    return bare


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one match; the match itself if it is not valid."""
    head = F.regexp_extract(match, r"^(?i:(?:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?)", 0)
    tail = lambda h: F.substr(match, F.length(h) + 1)
    country = F.regexp_extract(match, r"^(?:\+[0-9]{1,3}(?=[ .(-])|\+)?", 0)
    at = F.instr(match, "@")

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", F.concat(
                _mixed(key, "email", F.substr(match, F.lit(1), at - 1), inverse), F.substr(match, at)))
            .when(kind == "key", F.concat(F.lit("AKIA"), _mixed(key, "key", F.substr(match, F.lit(5)), inverse)))
            .when(kind == "secret", once(head, lambda h: F.concat(h, once(tail(h), lambda x: _secret(key, x, inverse)))))
            .when(kind == "iban", _iban(key, match, inverse))
            .when(kind == "phone", once(country, lambda h: F.concat(h, _mixed(key, "phone", tail(h), inverse))))
            .when(kind == "date", _date(key, match, inverse))
            .when(kind == "ssn", _ssn(key, match, inverse))
            .when(kind == "ip", _ip(key, match, inverse))
            .when(kind == "card", _card(key, match, inverse)).otherwise(match))

    return once(kind_of(match), of)


def replaced(text: Column, key: str, inverse: bool = False) -> Column:
    """A text with all its valid matches replaced. Texts without candidates are scanned once and left."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key, inverse))
    woven = F.zip_with(F.split(text, PATTERN, -1), matches, lambda a, m: F.concat(a, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(PATTERN), F.array_join(woven, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with the personal data in a text column replaced; all other columns as they are."""
    return docs.withColumn(column, replaced(F.col(column), key))


def restore(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Undoes pseudonymise() with the same key."""
    return docs.withColumn(column, replaced(F.col(column), key, inverse=True))
