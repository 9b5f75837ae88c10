"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates are found by pattern, checked (card numbers by their check
digit, IP addresses by their octets, dates by the calendar), and permuted inside
their own format: a value of one format becomes a value of the same format, two
values stay two, and equal values stay equal in all documents.  Whoever has the
key can undo it.  All of it is DataFrame expressions: the text is split at the
finds, and a permutation is arithmetic on two halves with rounds keyed by SHA-256.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import free_name, quoted

#: Where a session names the key.  No key is built in: who has it can undo the pseudonyms.
SETTING = "spark.sluiceway.pseudonym.key"
#: For trials on synthetic tables only: everyone can read it.
DEMO_KEY = "not-a-secret"
ROUNDS = 6

#: The kinds of value, in the order in which they are tried at a place.
#: Kind: pattern, without groups that capture.
EDGE, END = r"(?<![\w.@-])", r"(?![\w@-]|\.\d)"
#: How card numbers are mostly written: unbroken, 4-4-4-4, 4-6-5 or 4-6-4.
WRITTEN = r"(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})" + END
#: A find of digits does not begin where it would cut a number so written, nor go on into one after its 13th digit.
WHOLE = rf"(?!(?!{WRITTEN})(?=\d(?:[ -]?\d){{19}})(?:\d[ -]?){{1,12}}(?<= ){WRITTEN})"
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![\w-])",
    "date": EDGE + r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])" + END,
    "ssn": EDGE + r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}" + END,
    "ip": EDGE + r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)" + END,
    "card": EDGE + WHOLE + rf"\d(?:[ -]?\d){{12}}(?:(?! {WRITTEN})[ -]?\d){{0,6}}" + END,
    "phone": r"(?<![\w.@+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]" + rf"(?!{WRITTEN})\d{{4}}" + END,
}
FIND = "|".join(PATTERNS.values())
#: Days of one permuted stretch of the calendar: 200 * 365, counted from EPOCH.
DAYS_HIGH, DAYS_LOW, EPOCH = 200, 365, "1900-01-01"
#: The days of 0001-01-01 and 9999-12-31, counted from EPOCH.
DAYS = tuple((date(*d) - date(1900, 1, 1)).days for d in ((1, 1, 1), (9999, 12, 31)))


def _digest(key: str, kind: str, turn: int, shape: Column, half: Column) -> Column:
    """48 keyed pseudo-random bits of a half."""
    text = F.concat_ws("|", F.lit(f"{key}|{kind}|{turn}"), shape.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, key: str, kind: str, undo: bool = False, place: Column | None = None) -> Column:
    """A permutation of the pairs (high < high_size, low < low_size), as a struct of high and low.

    An alternating Feistel network: each round adds to one half, modulo its size,
    a keyed digest of the other, so any sizes will do.  Each place, if given, has
    a permutation of its own; that of a null place is the one without place.
    """
    shape = F.concat_ws("x", high_size.cast("string"), low_size.cast("string"), *([] if place is None else [place.cast("string")]))
    pair = F.struct(high.alias("a"), low.alias("b"))
    sign = -1 if undo else 1

    def add(half: Column, other: Column, size: Column, turn: int) -> Column:
        return F.pmod(half + sign * F.pmod(_digest(key, kind, turn, shape, other), size), size)

    def step(turn: int):
        if turn % 2 == 0:
            return lambda p: F.struct(add(p["a"], p["b"], high_size, turn).alias("a"), p["b"].alias("b"))
        return lambda p: F.struct(p["a"].alias("a"), add(p["b"], p["a"], low_size, turn).alias("b"))

    for turn in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        pair = _let(pair, step(turn))
    return pair


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    """10**n for n up to 18, exactly."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permute_digits(digits: Column, key: str, kind: str, undo: bool = False, place: Column | None = None) -> Column:
    """A string of 1 to 36 digits, permuted among the strings of its length."""
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")
    halves = lambda d: feistel(
        F.concat(F.lit("0"), F.substr(d, F.lit(1), cut)).cast("long"), F.substr(d, cut + 1, n).cast("long"), _power(cut), _power(n - cut), key, kind, undo, place
    )
    return _let(halves(digits), lambda p: F.concat(F.lpad(p["a"].cast("string"), cut, F.lit("0")), F.lpad(p["b"].cast("string"), n - cut, F.lit("0"))))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits (the last digit counts once)."""
    places = F.sequence(F.lit(1), F.length(digits))
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, k, F.lit(1)).cast("int")
        twice = (d * 2) % 10 + F.floor(d / 5).cast("int")
        return total + F.when((n - k) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10


def _into(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those of `digits`."""
    chars = F.transform(F.sequence(F.lit(1), F.length(value)), lambda k: F.substr(value, k, F.lit(1)))
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(chars, state, put, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _runs(value: Column) -> Column:
    """The runs of 13 to 19 digits of a value that begin and end with its groups: in the order in which they are tried.

    Structs of rank (0: as cards are mostly written), less (19 - digits) and skip (digits before).
    """
    sizes = F.transform(F.split(value, "[ -]"), F.length)
    before = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda t, n: t + n)
    groups = F.sequence(F.lit(1), F.size(sizes))

    def run(i: Column, j: Column) -> Column:
        skip, size = before(i - 1), before(j) - before(i - 1)
        # Each separator is one character.
        own = F.substr(value, skip + i, size + j - i)
        return F.struct(F.when(own.rlike(f"^{WRITTEN}$"), 0).otherwise(1).alias("rank"), (19 - size).alias("less"), skip.alias("skip"))

    pairs = F.flatten(F.transform(groups, lambda i: F.transform(F.filter(groups, lambda j: j >= i), lambda j: run(i, j))))
    return F.array_sort(F.filter(pairs, lambda r: r["less"].between(0, 6)))


def _card(value: Column, key: str, undo: bool) -> Column:
    """Card numbers: all digits but the last are permuted, the last is the new check digit.

    Other numbers may stand beside the card's: the first of the value's runs that
    passes the check is the card, the other digits stay.  If by chance the new
    digits let an earlier run pass, they are permuted again, so undo finds the
    same run.
    """

    def renew(d: Column) -> Column:
        body = _let(F.substr(d, F.lit(1), F.length(d) - 1), lambda x: permute_digits(x, key, "card", undo))
        return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    def card(runs: Column, d: Column) -> Column:
        return F.get(F.filter(runs, lambda r: luhn_sum(F.substr(d, r["skip"] + 1, 19 - r["less"])) == 0), F.lit(0))

    def put(d: Column, r: Column) -> Column:
        size = 19 - r["less"]
        return F.concat(F.substr(d, F.lit(1), r["skip"]), _let(F.substr(d, r["skip"] + 1, size), renew), F.substr(d, r["skip"] + size + 1, F.length(d)))

    def walk(runs: Column, d: Column, r: Column) -> Column:
        start = F.struct(d.alias("d"), F.lit(False).alias("done"))
        step = lambda s, _: F.when(s["done"], s).otherwise(_let(put(s["d"], r), lambda n: F.struct(n.alias("d"), (card(runs, n) == r).alias("done"))))
        return F.aggregate(F.sequence(F.lit(1), F.when(F.size(runs) > 1, 64).otherwise(1)), start, step, lambda s: s["d"])

    return _let(_digits(value), lambda d: _let(_runs(value), lambda runs: _let(card(runs, d), lambda r: F.when(r.isNotNull(), _into(value, walk(runs, d, r))).otherwise(value))))


def _phone(value: Column, key: str, undo: bool) -> Column:
    """Telephone numbers: the last ten digits are permuted, a country code stays."""

    def renew(d: Column) -> Column:
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permute_digits(F.right(d, F.lit(10)), key, "phone", undo))

    return _let(_digits(value), lambda d: _into(value, renew(d)))


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """Social security numbers, among those that pass the check: area, group and serial have 898, 99 and 9999 values."""
    area = F.substr(value, F.lit(1), F.lit(3)).cast("int")
    a = area - F.when(area > 666, 2).otherwise(1)
    low = (F.substr(value, F.lit(5), F.lit(2)).cast("long") - 1) * 9999 + F.substr(value, F.lit(8), F.lit(4)).cast("long") - 1
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def show(p: Column) -> Column:
        new = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", pad(new, 3), pad(F.floor(p["b"] / 9999) + 1, 2), pad(p["b"] % 9999 + 1, 4))

    return _let(feistel(a.cast("long"), low, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn", undo), show)


def _ip(value: Column, key: str, undo: bool) -> Column:
    """IPv4 addresses, among all addresses."""
    part = lambda k: F.element_at(F.split(value, r"\."), k).cast("long")
    size = F.lit(65536).cast("long")
    show = lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)))
    return _let(feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), size, size, key, "ip", undo), show)


def _date(value: Column, key: str, undo: bool) -> Column:
    """Dates from 0001-01-01 to 9999-12-31, each within its stretch of 73,000 days from EPOCH; impossible dates stay.

    The first and last stretch go beyond four digits: there the permutation is
    walked on until it comes back, which half of its days are.
    """
    day = F.date_diff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(EPOCH).cast("date")).cast("long")
    stretch = DAYS_HIGH * DAYS_LOW

    def renew(n: Column) -> Column:
        inner = F.pmod(n, F.lit(stretch))
        new = feistel(F.floor(inner / DAYS_LOW), inner % DAYS_LOW, F.lit(DAYS_HIGH).cast("long"), F.lit(DAYS_LOW).cast("long"), key, "date", undo)
        return _let(new, lambda p: n - inner + p["a"] * DAYS_LOW + p["b"])

    def walk(n: Column) -> Column:
        start = F.struct(n.alias("d"), F.lit(False).alias("done"))
        step = lambda s, _: F.when(s["done"], s).otherwise(_let(renew(s["d"]), lambda m: F.struct(m.alias("d"), m.between(*DAYS).alias("done"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["d"])

    show = lambda d: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), d.cast("int")), "yyyy-MM-dd")
    return F.coalesce(_let(day, lambda n: F.when(n.between(*DAYS), show(walk(n)))), value)


def _email(value: Column, key: str, undo: bool) -> Column:
    """Addresses: the digits and the letters of the local part are permuted in place, each by its position.

    Capitals stay capitals.  Of longer local parts each 22 letters and each 36
    digits are permuted together, by their place: a half must fit a whole number,
    that of letters one that division (a double's) spells exactly.
    """
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    # Letters are digits to the base 26, so a local part is two numbers of their own bases, split in halves.
    letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))

    def pieces(s: Column, size: int, use) -> Column:
        """use(piece, place) for each `size` characters of s, joined; the first piece has a null place."""
        numbers = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int"))
        one = lambda k: _let(F.substr(s, k * size + 1, F.lit(size)), lambda x: use(x, F.nullif(k, F.lit(0))))
        return F.array_join(F.transform(numbers, one), "")

    def number(s: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: (F.ascii(F.substr(s, k, F.lit(1))) - 97).cast("long"))
        return F.when(F.length(s) > 0, F.aggregate(chars, F.lit(0).cast("long"), lambda t, c: t * 26 + c)).otherwise(F.lit(0).cast("long"))

    def size(s: Column) -> Column:
        return F.when(F.length(s) > 0, F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(1).cast("long"), lambda t, _: t * 26)).otherwise(F.lit(1).cast("long"))

    def spell(v: Column, n: Column) -> Column:
        start = F.struct(v.cast("long").alias("v"), F.lit("").alias("out"))
        step = lambda s, _: F.struct(F.floor(s["v"] / 26).cast("long").alias("v"), F.concat(F.char((s["v"] % 26 + 97).cast("int")), s["out"]).alias("out"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["out"])).otherwise(F.lit(""))

    def renew(s: Column, place: Column) -> Column:
        n = F.length(s)
        cut = F.floor(n / 2).cast("int")
        a, b = F.substr(s, F.lit(1), cut), F.substr(s, cut + 1, n)
        return _let(feistel(number(a), number(b), size(a), size(b), key, "email", undo, place), lambda p: F.concat(spell(p["a"], cut), spell(p["b"], n - cut)))

    chars = F.transform(F.sequence(F.lit(1), F.length(local)), lambda k: F.substr(local, k, F.lit(1)))

    def spread(new: Column) -> Column:
        state = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        small, capital = lambda c: (c >= "a") & (c <= "z"), lambda c: (c >= "A") & (c <= "Z")
        put = lambda s, c: F.struct(
            F.concat(s["out"], F.when(small(c), F.substr(new, s["k"], F.lit(1))).when(capital(c), F.upper(F.substr(new, s["k"], F.lit(1)))).otherwise(c)).alias("out"),
            (s["k"] + F.when(small(c) | capital(c), 1).otherwise(0)).alias("k"),
        )
        return F.aggregate(chars, state, put, lambda s: s["out"])

    def numbers(kept: Column) -> Column:
        new = lambda d: pieces(d, 36, lambda x, k: permute_digits(x, key, "email", undo, k))
        return _let(_digits(kept), lambda d: F.when(F.length(d) > 0, _let(new(d), lambda x: _into(kept, x))).otherwise(kept))

    lettered = F.when(F.length(letters) > 0, _let(_let(letters, lambda s: pieces(s, 22, renew)), spread)).otherwise(local)
    return F.concat_ws("@", _let(lettered, numbers), domain)


RENEW = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}
_SHAPES = {k: "^(?:" + p.replace(EDGE, "").replace(END, "").replace(r"(?<![\w.+%-])", "").replace(r"(?<![\w.@+-])", "").replace(r"(?![\w-])", "") + ")$" for k, p in PATTERNS.items()}


def kind_of(value: Column) -> Column:
    return reduce(lambda rest, k: F.when(value.rlike(_SHAPES[k]), k).otherwise(rest), reversed(PATTERNS), F.lit("none"))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a whole value; a value of no kind, or one that fails its check, stays."""
    if not key:
        raise ValueError(f"pseudonyms need a key, as set in {SETTING}")
    kind = kind_of(value)
    return reduce(lambda rest, k: F.when(kind == k, RENEW[k](value, key, undo)).otherwise(rest), RENEW, value)


def _searched(docs: DataFrame, key: str, undo: bool) -> tuple[DataFrame, Column, str, str]:
    """docs with two more columns, the new text, and the two columns' names: the finds and what they become."""
    text, old, new = F.col("text"), free_name(docs, "_old"), free_name(docs, "_new")
    likely = text.rlike(r"\d[\d ().-]*\d") | text.contains("@")
    # Texts without digits in a row or an @ are not searched.
    finds = F.when(likely, F.regexp_extract_all(text, F.lit(FIND), F.lit(0))).otherwise(F.array().cast("array<string>"))
    base = docs.withColumn(old, F.coalesce(finds, F.array().cast("array<string>")))
    base = base.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda v: pseudonym(v, key, undo))).otherwise(F.col(old)))
    between = F.split(text, FIND, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return base, F.when(F.size(old) > 0, joined).otherwise(text), old, new


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """docs with the personal values of text replaced, and n_found, n_changed after the other columns.

    n_found: places that look like a value; n_changed: those that were replaced
    by another value; columns of docs named so are replaced.  Null texts stay
    null with 0 found; texts without a find stay as they are.  All rows, repeated
    ones too, are treated alike; the key is the only other input, so equal values
    get equal pseudonyms in all documents.  With undo and the same key the call
    gives the first text back.
    """
    base, text, old, new = _searched(docs, key, undo)
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    found = base.withColumns({"text": text, "n_found": F.size(old).cast("long"), "n_changed": F.when(F.size(old) > 0, changed).otherwise(0).cast("long")})
    return found.select(*[quoted(c) for c in docs.columns if c.lower() not in ("n_found", "n_changed")], "n_found", "n_changed")


def replaced_text(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """docs with the personal values of text replaced, as pseudonymise does it; exactly the columns of docs."""
    base, text, _, _ = _searched(docs, key, undo)
    return base.withColumn("text", text).select(*map(quoted, docs.columns))
