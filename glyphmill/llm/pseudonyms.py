"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

Every value found is read as a short row of numbers, each below a base of its own (decimal digits, letters, octets, the
parts of a day number), and permuted within those bases. The result is again a valid value of the same format, with its
check digits worked out anew, so equal values stay equal in all documents and different ones stay different. With the key
the same network run backwards restores them. Only column expressions are used, on matches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.rows import let

#: Rounds of the network.
ROUNDS = 10
#: Most times that a card is permuted anew because a reading before its own fits by chance: at most one time in two, mostly never.
_WALK = 64

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = "(?:18|19|20|21)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
#: What may hold a value of each kind; the first that fits a place decides, and its checks follow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": rf"(?<![0-9./\-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR})(?![0-9/\-]|\.[0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "secret": r"(?<=[\"'])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?=[\"'])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: 400 Gregorian years have 146,097 days, 189 times 773, and begin anew on the same weekday.
_DAYS = (189, 773)


def network(values: Column, bases: Column, tweak: Column, key: str, undo: bool = False) -> Column:
    """``values``, each from 0 to below its base, permuted jointly: alternately one half is shifted by a digest of the other."""
    n = F.size(values)
    left = F.floor(n / 2).cast("int")

    def shifted(part: Column, others: Column, first: Column, i: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(key + "|"), tweak, F.lit("|"), i.cast("string"), F.lit("|"), F.array_join(others.cast("array<string>"), ",")), 512)

        def shift(h: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                base = F.get(bases, first + j)
                by = F.conv(F.substring(h, 4 * (j % 32) + 1, F.lit(4)), 16, 10).cast("int")
                return F.pmod(x - by if undo else x + by, base)

            return F.transform(part, one)

        return let(digest, shift)

    def round_(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["a"], s["b"], F.lit(0), i).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], left, i).alias("b"))
        )

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    start = F.struct(F.slice(values, F.lit(1), left).alias("a"), F.slice(values, left + 1, n - left).alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, round_, lambda s: F.concat(s["a"], s["b"]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _class(c: Column, hexed: bool = False) -> Column:
    """The alphabet of a character; null for one that stays as it is."""
    if hexed:
        return F.when(c.rlike("[0-9a-f]"), F.lit(_DIGITS + "abcdef")).when(c.rlike("[A-F]"), F.lit(_DIGITS + "ABCDEF"))
    return F.when(c.rlike("[0-9]"), F.lit(_DIGITS)).when(c.rlike("[a-z]"), F.lit(_LOWER)).when(c.rlike("[A-Z]"), F.lit(_UPPER))


def _by_character(text: Column, tweak: str, key: str, undo: bool, alphabet=_class) -> Column:
    """Characters permuted within their alphabets; the others keep their places."""
    cells = F.transform(_chars(text), lambda c: F.struct(c.alias("c"), alphabet(c).alias("of")))

    def filled(cells: Column) -> Column:
        live = F.filter(cells, lambda x: x["of"].isNotNull())
        values = F.transform(live, lambda x: (F.instr(x["of"], x["c"]) - 1).cast("int"))
        bases = F.transform(live, lambda x: F.length(x["of"]))
        # The pattern of alphabets is part of the tweak: formats do not share a permutation.
        shape = F.concat(F.lit(tweak + ":"), F.array_join(bases.cast("array<string>"), ","))
        new = network(values, bases, shape, key, undo)
        return let(new, lambda v: F.aggregate(
            cells, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
            lambda s, x: F.struct(
                (s["k"] + x["of"].isNotNull().cast("int")).alias("k"),
                F.concat(s["out"], F.coalesce(F.substring(x["of"], F.get(v, s["k"]) + 1, F.lit(1)), x["c"])).alias("out"),
            ),
            lambda s: s["out"],
        ))

    return let(cells, filled)


def _numbers(text: Column, bases: list[int], tweak: str, key: str, undo: bool) -> Column:
    return network(text, F.array(*[F.lit(b) for b in bases]), F.lit(tweak), key, undo)


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum over an array of digits of which the last is not the check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _digits_of(text: Column) -> Column:
    return F.transform(F.filter(_chars(text), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def luhn_valid(text: Column) -> Column:
    return let(_digits_of(text), lambda d: (_luhn_sum(F.slice(d, F.lit(1), F.size(d) - 1)) + F.element_at(d, -1)) % 10 == 0)


def _readings(text: Column) -> Column:
    """Where a card may lie in a match, by layout alone: the whole, then usual layouts, then any run of groups of 13 to 19 digits."""

    def found(groups: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            part = F.slice(groups, i, j - i + 1)
            n, shape = F.length(F.array_join(part, "")), F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), " ")
            whole = (i == 1) & (j == F.size(groups))
            rank = F.when(whole, 0).when((i == j) | shape.isin("4 4 4 4", "4 6 5"), 1).otherwise(2)
            at = F.length(F.array_join(F.slice(groups, F.lit(1), i - 1), "-")) + F.when(i > 1, 2).otherwise(1)
            return F.struct(rank.alias("rank"), (-n).alias("less"), at.alias("at"), F.length(F.array_join(part, "-")).alias("size"))

        every = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.transform(F.sequence(i, F.size(groups)), lambda j: one(i, j)))
        return F.array_sort(F.filter(F.flatten(every), lambda r: r["less"].between(-19, -13)))

    return let(F.split(text, r"[ \-]"), found)


def _reading(text: Column) -> Column:
    """The first reading of a match whose check digit fits; null where none does."""
    return F.get(F.filter(_readings(text), lambda r: luhn_valid(F.substring(text, r["at"], r["size"]))), F.lit(0))


def _card(text: Column, key: str, undo: bool) -> Column:
    """The card in a match is replaced until the same reading comes first again, so that undoing finds it too."""

    def walked(of: Column) -> Column:
        def once(t: Column) -> Column:
            new = _card_number(F.substring(t, of["at"], of["size"]), key, undo)
            return F.concat(F.substring(t, F.lit(1), of["at"] - 1), new, F.substring(t, of["at"] + of["size"], F.length(t)))

        def step(s: Column, _: Column) -> Column:
            made = let(once(s["text"]), lambda t: F.struct(t.alias("text"), F.coalesce(_reading(t) == of, F.lit(False)).alias("done")))
            return F.when(s["done"], s).otherwise(made)

        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, step, lambda s: s["text"])

    return let(_reading(text), walked)


def _card_number(text: Column, key: str, undo: bool) -> Column:
    body = _by_character(F.substring(text, F.lit(1), F.length(text) - 1), "card", key, undo)
    return let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(_digits_of(b)), F.lit(10)).cast("string")))


def _remainder(text: Column) -> Column:
    """The remainder by 97 of an account number, letters read as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def iban_valid(text: Column) -> Column:
    return _remainder(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))) == 1


def _iban(text: Column, key: str, undo: bool) -> Column:
    country = F.substring(text, 1, 2)
    body = _by_character(F.substring(text, F.lit(5), F.length(text)), "iban", key, undo)
    return let(body, lambda b: F.concat(country, F.lpad((98 - _remainder(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def _email(text: Column, key: str, undo: bool) -> Column:
    end = F.concat(F.lit("."), F.substring_index(text, ".", -1))
    return F.concat(_by_character(F.substring(text, F.lit(1), F.length(text) - F.length(end)), "email", key, undo), end)


def _phone(text: Column, key: str, undo: bool) -> Column:
    country = F.regexp_extract(text, r"^(\+[0-9]{1,3}[ .\-]?(?=[(0-9]))?", 0)
    return F.concat(country, _by_character(F.substring(text, F.length(country) + 1, F.length(text)), "phone", key, undo))


def _ip(text: Column, key: str, undo: bool) -> Column:
    return F.array_join(_numbers(F.split(text, r"\.").cast("array<int>"), [256] * 4, "ip", key, undo).cast("array<string>"), ".")


def _ssn(text: Column, key: str, undo: bool) -> Column:
    # 1 to 899 without 666; 1 to 99; 1 to 9999.
    parts = F.split(text, "-").cast("array<int>")
    area = F.get(parts, F.lit(0))
    values = F.array(area - 1 - (area > 666).cast("int"), F.get(parts, F.lit(1)) - 1, F.get(parts, F.lit(2)) - 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return let(_numbers(values, [898, 99, 9999], "ssn", key, undo), lambda v: F.concat_ws(
        "-", pad(F.get(v, F.lit(0)) + 1 + (F.get(v, F.lit(0)) >= 665).cast("int"), 3), pad(F.get(v, F.lit(1)) + 1, 2), pad(F.get(v, F.lit(2)) + 1, 4)
    ))


_FORMATS = {r"^....-": "yyyy-MM-dd", r"^..\.": "dd.MM.yyyy", r"^../": "MM/dd/yyyy"}


def _parsed(text: Column) -> Column:
    out = F.lit(None).cast("date")
    for shape, form in _FORMATS.items():
        out = F.when(text.rlike(shape), F.try_to_date(text, form)).otherwise(out)
    return out


def _date(text: Column, key: str, undo: bool) -> Column:
    day = F.datediff(_parsed(text), F.to_date(F.lit("1800-01-01")))
    values = F.array(F.floor(day / _DAYS[1]).cast("int"), day % _DAYS[1])

    def shown(v: Column) -> Column:
        new = F.date_add(F.to_date(F.lit("1800-01-01")), F.get(v, F.lit(0)) * _DAYS[1] + F.get(v, F.lit(1)))
        out = F.lit(None).cast("string")
        for shape, form in _FORMATS.items():
            out = F.when(text.rlike(shape), F.date_format(new, form)).otherwise(out)
        return out

    return let(_numbers(values, list(_DAYS), "date", key, undo), shown)


def _secret(text: Column, key: str, undo: bool) -> Column:
    upper = text.rlike("[A-F]")
    return F.when(upper, _by_character(text, "secret", key, undo, lambda c: F.lit(_DIGITS + "ABCDEF"))).otherwise(
        _by_character(text, "secret", key, undo, lambda c: F.lit(_DIGITS + "abcdef"))
    )


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match; the match itself where no kind holds it to be valid."""
    kind = {
        "email": (F.lit(True), _email), "iban": (iban_valid(value), _iban), "date": (_parsed(value).isNotNull(), _date), "ip": (F.lit(True), _ip),
        "ssn": (F.lit(True), _ssn), "phone": (F.lit(True), _phone), "card": (_reading(value).isNotNull(), _card), "secret": (F.lit(True), _secret),
    }
    # Without the neighbours that a pattern looks at, the kinds can be told apart on the match alone.
    out = value
    for name in reversed(PATTERNS):
        valid, made = kind[name]
        alone = PATTERNS[name].replace(r"(?<=[\"'])", "").replace(r"(?=[\"'])", "")
        out = F.when(value.rlike(f"^(?:{alone})$"), F.when(valid, made(value, key, undo)).otherwise(value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with all valid values in ``text`` replaced, and ``n_pseudonyms``, how many those are.

    Null stays null, empty stays empty, repeated rows get equal results; what is not valid (a check digit that does not fit, a
    day that does not exist) stays as it is, and so does all other text. ``undo`` with the same key restores the texts. Whoever
    sees the plan sees the key. A column ``n_pseudonyms`` of ``docs`` is replaced.
    """
    docs = docs.drop("n_pseudonyms")
    found = docs.withColumn("_found", F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    new = found.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key, undo)))
    between = F.split(text, _ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col("_new"), lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    replaced = F.when(F.size("_found") > 0, woven).otherwise(F.col(text))
    return new.withColumns({text: replaced, "n_pseudonyms": F.coalesce(changed, F.lit(0)).cast("long")}).drop("_found", "_new").select(*docs.columns, "n_pseudonyms")
