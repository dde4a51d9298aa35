"""Format-preserving pseudonyms for personal data, as column expressions.

A value (card number, phone number, IPv4 address, date, local part of a mail address) is a
list of small numbers, each below its own radix. A keyed Feistel network swaps and adds
its two halves; every step can be undone, so the whole is a permutation of the values of
one format, and equal values get equal pseudonyms in every document. Card numbers keep a
right Luhn digit, dates stay dates. Numbers that fail their check are left as they are.
Card numbers are looked for in every part of a run of numbers, so a number beside one hides nothing;
they need a card's form and an issuer's first digits, so plain numbers in a row stay.
Null texts stay null; text without findings is returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.common import on_plain_names

ROUNDS = 8
# Days from 1900-01-01 to 2099-12-30: 73,048 = 184 * 397.
FIRST_DAY, DAY_RADICES = "1900-01-01", (184, 397)
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?\d{1,3}[ -]?)?\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\w)"
# A run of numbers with single blanks or hyphens between, up to where a value of another kind begins.
OTHERS = "|".join((MAIL, ADDRESS, DATE, PHONE))
CARD = rf"(?<!\w)(?=\d(?:[ -]?\d){{12}})(?!{MAIL})\d++(?!\w)(?:[ -](?!{OTHERS})\d++(?!\w))*+"
CARD_DIGITS = (13, 19)
# Sizes of the groups of a card number; the first is any unbroken one.
CARD_FORMS = ((16,), (4, 6, 4), (4, 6, 5), (4, 4, 4, 4), (4, 4, 4, 4, 3))
# First digits of card issuers, with the lengths that go with them.
ISSUERS = "^(?:" + "|".join((
    r"4(?:\d{12}|\d{15}|\d{18})",
    r"(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}",
    r"3[47]\d{13}",
    r"3(?:0[0-5]|[68]\d|9\d)\d{11}",
    r"35(?:2[89]|[3-8]\d)\d{12,15}",
    r"6(?:011|4[4-9]\d|5\d\d|2\d\d)\d{12,15}",
    r"(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15}",
)) + ")$"
# The look-ahead spares most positions the alternatives.
NUMBERS = "(?=[0-9+(])(?:" + "|".join((ADDRESS, DATE, PHONE, CARD)) + ")"
FOUND = f"{NUMBERS}|{MAIL}"
KINDS = ("mail", "address", "date", "phone", "card")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def permuted(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Feistel network over the elements of ``values``; element i stays below ``radices[i]``."""
    def turn(state: Column, k: Column) -> Column:
        def moved(digest: Column) -> Column:
            added = F.transform(
                state["left"],
                lambda x, i: F.pmod(
                    x + F.conv(F.substring(digest, F.lit(1) + 4 * (i % 16), F.lit(4)), 16, 10).cast("int"),
                    F.get(state["left_radix"], i),
                ),
            )
            return F.struct(
                state["right"].alias("left"), added.alias("right"),
                state["right_radix"].alias("left_radix"), state["left_radix"].alias("right_radix"),
            )

        content = F.concat_ws(
            ",", F.lit(key), F.lit(kind), k.cast("string"),
            F.array_join(F.transform(state["right"], lambda x: x.cast("string")), "."),
            F.array_join(F.transform(state["left_radix"], lambda x: x.cast("string")), "."),
        )
        return let(F.sha2(content, 256), moved)

    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    start = F.struct(
        F.slice(values, F.lit(1), half).alias("left"), F.slice(values, half + 1, rest).alias("right"),
        F.slice(radices, F.lit(1), half).alias("left_radix"), F.slice(radices, half + 1, rest).alias("right_radix"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["left"], s["right"])
    )


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def digits(value: Column) -> Column:
    return F.transform(characters(F.regexp_replace(value, r"\D", "")), lambda c: c.cast("int"))


def luhn_sum(numbers: Column) -> Column:
    """Luhn sum of the digits, where the last one counts once."""
    doubled = F.transform(
        F.reverse(numbers),
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d)


def refill(value: Column, numbers: Column) -> Column:
    """``value`` with its digits, in order, replaced by ``numbers``."""
    rank = lambda chars, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: c.rlike(r"\d")))
    return let(characters(value), lambda chars: let(numbers, lambda ds: F.array_join(F.transform(
        chars, lambda c, i: F.when(c.rlike(r"\d"), F.get(ds, rank(chars, i) - 1).cast("string")).otherwise(c)
    ), "")))


def tens(numbers: Column) -> Column:
    return F.transform(numbers, lambda _: F.lit(10))


def card_spans(groups: Column, marks: Column) -> Column:
    """Parts of a run of digit groups that are card numbers, as (at, count) of groups in order.

    A card is one group, or groups of a card's usual sizes with one kind of mark between; it has an issuer's first digits
    with their length, and a right Luhn digit.  The run is read from left to right, and a
    card begins after the one before it.
    """
    def count(at: Column) -> Column:
        def fits(sizes: tuple[int, ...]) -> Column:
            inner = [F.length(F.get(groups, at + i)) == n for i, n in enumerate(sizes)]
            alike = [F.get(marks, at + i) == F.get(marks, at) for i in range(1, len(sizes) - 1)]
            number = F.array_join(F.slice(groups, at + 1, len(sizes)), "")
            checks = let(number, lambda ds: ds.rlike(ISSUERS) & (luhn_sum(digits(ds)) % 10 == 0))
            whole = inner[0] if len(sizes) > 1 else F.length(F.get(groups, at)).between(*CARD_DIGITS)
            for test in [*inner[1:], *alike]:
                whole = whole & test
            return F.when(F.coalesce(whole, F.lit(False)), F.coalesce(checks, F.lit(False))).otherwise(F.lit(False))

        # Longer forms first.
        out = F.lit(0)
        for sizes in CARD_FORMS:
            out = F.when(fits(sizes), F.lit(len(sizes))).otherwise(out)
        return out

    counts = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda at: F.struct((at + 1).alias("at"), count(at).alias("count")))
    start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<at:int,count:int>>").alias("spans"))
    return F.aggregate(
        F.filter(counts, lambda s: s["count"] > 0), start,
        lambda state, s: F.when(s["at"] < state["end"], state).otherwise(F.struct(
            (s["at"] + s["count"]).alias("end"), F.concat(state["spans"], F.array(s)).alias("spans"),
        )),
        lambda state: state["spans"],
    )


def cards_pseudonym(value: Column, key: str) -> Column:
    """The run with its card numbers replaced, and their number; null without one."""
    def rebuilt(parts: Column, spans: Column) -> Column:
        # Part 2 i - 1 is group i, part 2 i the mark after it.
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: 2 * (s["at"] + s["count"]) - 3))
        text = lambda first, n: F.array_join(F.slice(parts, first, n), "")
        new = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, end: F.concat(
            text(end + 1, 2 * s["at"] - 2 - end), card_pseudonym(text(2 * s["at"] - 1, 2 * s["count"] - 1), key)
        ))
        rest = let(F.element_at(ends, -1), lambda end: text(end + 1, F.size(parts) - end))
        return F.when(F.size(spans) > 0, F.struct(
            F.concat(F.array_join(new, ""), rest).alias("text"), F.size(spans).alias("n")
        ))

    parts = F.regexp_extract_all(value, F.lit(r"\d+|[ -]"), F.lit(0))
    groups = F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
    marks = F.regexp_extract_all(value, F.lit("[ -]"), F.lit(0))
    return let(parts, lambda ps: let(card_spans(groups, marks), lambda spans: rebuilt(ps, spans)))


def card_pseudonym(value: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.array(F.pmod(-luhn_sum(F.concat(body, F.array(F.lit(0)))), F.lit(10))))

    def changed(ds: Column) -> Column:
        body = F.slice(ds, F.lit(1), F.size(ds) - 1)
        return F.when(luhn_sum(ds) % 10 == 0, refill(value, let(permuted(body, tens(body), key, "card"), checked)))

    return let(digits(value), changed)


def phone_pseudonym(value: Column, key: str) -> Column:
    return refill(value, let(digits(value), lambda ds: permuted(ds, tens(ds), key, "phone")))


def address_pseudonym(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return let(octets, lambda xs: F.when(
        F.forall(xs, lambda x: x < 256),
        F.array_join(F.transform(permuted(xs, F.transform(xs, lambda _: F.lit(256)), key, "address"), lambda x: x.cast("string")), "."),
    ))


def date_pseudonym(value: Column, key: str) -> Column:
    first = F.to_date(F.lit(FIRST_DAY))
    formats = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy"))

    def moved(day: Column) -> Column:
        parts = F.array(F.floor(day / DAY_RADICES[1]).cast("int"), F.pmod(day, F.lit(DAY_RADICES[1])))
        out = permuted(parts, F.array(*map(F.lit, DAY_RADICES)), key, "date")
        return let(out, lambda p: F.date_add(first, F.get(p, 0) * DAY_RADICES[1] + F.get(p, 1)))

    def one(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), first)
        inside = lambda d: F.when((d >= 0) & (d < DAY_RADICES[0] * DAY_RADICES[1]), F.date_format(moved(d), form))
        return let(day, inside)

    return F.coalesce(*[F.when(value.rlike(start), one(form)) for start, form in formats])


def mail_pseudonym(value: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted; other marks and the domain stay."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    classes = (("[a-z]", "a", 26), ("[A-Z]", "A", 26), ("[0-9]", "0", 10))

    def pick(c: Column, column) -> Column:
        out = F.when(c.rlike(classes[0][0]), column(*classes[0]))
        for cls in classes[1:]:
            out = out.when(c.rlike(cls[0]), column(*cls))
        return out

    def built(chars: Column) -> Column:
        radices = F.transform(chars, lambda c: F.coalesce(pick(c, lambda _, __, n: F.lit(n)), F.lit(1)))
        values = F.transform(chars, lambda c: F.coalesce(pick(c, lambda _, base, __: F.ascii(c) - ord(base)), F.lit(0)))
        return let(permuted(values, radices, key, "mail"), lambda out: F.array_join(F.transform(
            chars, lambda c, i: F.coalesce(pick(c, lambda _, base, __: F.char(F.get(out, i) + ord(base))), c)
        ), ""))

    return F.concat(let(characters(local), built), F.lit("@"), domain)


def pseudonym(value: Column, key: str) -> Column:
    """Kind, pseudonym and number of replaced values of one found value; kind null where its check fails."""
    makers = (mail_pseudonym, address_pseudonym, date_pseudonym, phone_pseudonym)
    patterns = (MAIL, ADDRESS, DATE, PHONE)
    new = None
    kind = None
    for name, pattern, make in zip(KINDS, patterns, makers):
        test = value.rlike(f"^(?:{pattern})$")
        made = let(make(value, key), lambda out: F.when(out.isNotNull(), F.struct(out.alias("text"), F.lit(1).alias("n"))))
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
        new = F.when(test, made) if new is None else new.when(test, made)
    kind, new = kind.otherwise(F.lit("card")), new.otherwise(cards_pseudonym(value, key))
    return let(new, lambda out: F.struct(
        F.when(out.isNotNull(), kind).alias("kind"), F.coalesce(out["text"], value).alias("text"), F.coalesce(out["n"], F.lit(0)).alias("n"),
    ))


def of_kind(found: Column, kind: str) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.when(x["kind"] == kind, x["n"]).otherwise(0))


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with personal values of ``column`` replaced, and counts per kind in ``pii_<kind>`` after its own columns.

    Own columns stay as they are, also those whose names are like the counts'.
    """
    counts = [f"pii_{k}" for k in KINDS]
    return on_plain_names(docs, [column], lambda rows: _rewritten_rows(rows, key, column), counts)


def _rewritten_rows(docs: DataFrame, key: str, column: str) -> DataFrame:
    text = F.col(column)

    def rewritten(found: Column) -> Column:
        def joined(new: Column) -> Column:
            after = F.concat(F.transform(new, lambda x: x["text"]), F.array(F.lit("")))
            parts = F.zip_with(F.split(text, FOUND, -1), after, lambda gap, value: F.concat(gap, value))
            counts = [of_kind(new, k).alias(f"pii_{k}") for k in KINDS]
            return F.struct(F.array_join(parts, "").alias("text"), *counts)

        none = F.struct(text.alias("text"), *[F.lit(0).cast("long").alias(f"pii_{k}") for k in KINDS])
        changed = let(F.transform(found, lambda value: pseudonym(value, key)), joined)
        return F.when(F.size(found) > 0, changed).otherwise(none)

    found = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0))
    )
    done = let(found, rewritten)
    result = docs.select(*docs.columns, done.alias("pii_result"))
    count = lambda k: F.coalesce(F.col(f"pii_result.pii_{k}"), F.lit(0).cast("long")).alias(f"pii_{k}")
    kept = [F.col("pii_result.text").alias(column) if c == column else c for c in docs.columns]
    return result.select(*kept, *[count(k) for k in KINDS])
