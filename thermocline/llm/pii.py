"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers, dates and addresses are permuted within their format by a keyed Feistel
network: equal values get equal pseudonyms in every document, different values different ones,
and the holder of the key can take them back. A value that fails its validation (a card number
with a wrong check digit, an impossible date) is not personal data and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import as_payload, with_outputs

ROUNDS = 8
KINDS = ("email", "phone", "ip", "card", "date", "ssn")

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_LONG_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"

# Notations of dates, each with how it may be read (the first that gives a date counts).
DATES = [
    (r"\d{4}-\d{2}-\d{2}", ["yyyy-MM-dd"]),
    (r"\d{4}/\d{2}/\d{2}", ["yyyy/MM/dd"]),
    (r"\d{4}\.\d{2}\.\d{2}", ["yyyy.MM.dd"]),
    (r"\d{2}/\d{2}/\d{4}", ["MM/dd/yyyy", "dd/MM/yyyy"]),
    (r"\d{2}\.\d{2}\.\d{4}", ["dd.MM.yyyy", "MM.dd.yyyy"]),
    (r"\d{2}-\d{2}-\d{4}", ["MM-dd-yyyy", "dd-MM-yyyy"]),
    (r"\d{1,2}/\d{1,2}/\d{4}", ["M/d/yyyy", "d/M/yyyy"]),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", ["d.M.yyyy", "M.d.yyyy"]),
    (rf"\d{{1,2}} {_LONG_MONTH} \d{{4}}", ["d MMMM yyyy"]),
    (rf"\d{{1,2}} {_MONTH} \d{{4}}", ["d MMM yyyy"]),
    (rf"{_LONG_MONTH} \d{{1,2}}, \d{{4}}", ["MMMM d, yyyy"]),
    (rf"{_MONTH} \d{{1,2}}, \d{{4}}", ["MMM d, yyyy"]),
]

# Country codes of one and two digits (others have three), and of those with numbers of 9 or 10 digits.
_CODE = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_NINE, _TEN = "(?:27|3[134]|41|48|61|66)", "(?:[17]|44|52|57|63|90|91|92)"
_INTERNATIONAL = (
    rf"\+(?:{_NINE}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d\)?){{9}}|{_TEN}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d\)?){{10}}"
    r"|\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}|\d{8,15}|\d{1,3}(?:[ .-]?\(\d{1,5}\)|[ ./-]\d{1,10}){1,6})(?!\d)"
)
_NATIONAL = (  # but not the start of a card in its usual groups
    r"(?!\d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d|\d{6}[ -]\d{4,5}(?!\d)))(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?:[ .-]\d{2}){4}"
    r"|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{3,4})?|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d{1,4}[ /]\d{5,8})(?!\w|[.-]\d)"
)

# Patterns of what may be personal data, by kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "phone": rf"(?<![\w+])(?:{_INTERNATIONAL}|(?<![.-])(?<!\d[ /(]){_NATIONAL})",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    # a date may follow another of its kind after a slash (an interval) and be followed by a time
    "date": rf"(?<![\w-])(?<!\d\.)(?<!(?<!-\d\d)/)(?:{'|'.join(r for r, _ in DATES)})(?!\d|[.-]\d|/\d{{1,2}}(?!\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}
# a whole run of digit groups up to the next value of another kind; the cards are looked for inside
PATTERNS["card"] = (
    r"(?<!\w)(?<!\d\.)(?=\d(?:[ -]?\d){12})\d++(?!\w)"
    rf"(?:[ -](?!{PATTERNS['date']}|{PATTERNS['ssn']}|(?:\d{{1,3}}\.){{3}}\d|\d{{3}}-\d{{3}}-\d{{4}}(?![\w-]))\d++(?!\w))*+"
)
ANY = "|".join(PATTERNS[k] for k in ("email", "phone", "ip", "date", "ssn", "card"))
#: Days from 1900-01-01 that dates are permuted among: 270 * 270, to 2099-08-04.
DAY_SIDE = 270


def _round(key: str, kind: str, size: Column | int, i: Column, other: Column) -> Column:
    """The round function: 60 bits of a keyed hash."""
    tweak = [F.lit(f"{key}|{kind}|"), size if isinstance(size, Column) else F.lit(size), F.lit("|"), i, F.lit("|"), other]
    return F.conv(F.left(F.sha2(F.concat(*[t.cast("string") for t in tweak]), 256), F.lit(15)), 16, 10).cast("long")


def permute(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, tweak: Column | int, back: bool = False) -> Column:
    """A keyed permutation of pairs (left, right) below (left_size, right_size): rounds add the hash of one side to the other."""
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(s["l"] + sign * F.pmod(_round(key, kind, tweak, i, s["r"]), left_size), left_size)
        odd = F.pmod(s["r"] + sign * F.pmod(_round(key, kind, tweak, i, s["l"]), right_size), right_size)
        return F.when(i % 2 == 0, F.struct(even.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), odd.alias("r")))

    return F.aggregate(steps, F.struct(left.alias("l"), right.alias("r")), step)


def _text_permuted(s: Column, radix: int, key: str, kind: str, back: bool) -> Column:
    """A string of digits (radix 10, up to 36) or lower-case letters and digits (radix 36, up to 24), permuted in its length."""
    n = F.length(s)
    half = F.floor(n / 2).cast("int")
    number = lambda x: F.conv(F.concat(F.lit("0"), x), radix, 10).cast("long")
    size = lambda k: F.element_at(F.array(*[F.lit(radix**i) for i in range(19 if radix == 10 else 13)]), k + 1)
    out = permute(number(F.left(s, half)), number(F.substr(s, half + 1)), size(half), size(n - half), key, kind, n, back)
    shown = lambda x, k: F.when(k == 0, "").otherwise(F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), k, "0"))
    return F.transform(F.array(out), lambda o: F.concat(shown(o["l"], half), shown(o["r"], n - half)))[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _laid_out(form: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``form``."""
    chars = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(F.substr(form, i, F.lit(1)).rlike(r"\d"), F.substr(digits, F.length(_digits(F.left(form, i))), F.lit(1))).otherwise(F.substr(form, i, F.lit(1))))
    return F.array_join(chars, "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test, modulo 10."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.array(F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0])
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def _one_card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    body = _text_permuted(F.left(digits, F.length(digits) - 1), 10, key, "card", back)
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.transform(F.array(full), lambda d: _laid_out(m, d))[0]


def _cards(m: Column, key: str, back: bool) -> Column:
    """A run of digit groups with its cards changed, and their number: of the sub-runs of whole groups
    with 13 to 19 digits that pass the Luhn test the longest first, then others that leave it free."""
    def pieces(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.length(_digits(g)))
        return F.transform(F.array(F.struct(groups.alias("g"), sizes.alias("n"))), whole)[0]

    def whole(r: Column) -> Column:
        def from_group(i: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(r["g"]) - i)), lambda k: F.aggregate(F.slice(r["n"], i + 1, k), F.lit(0), lambda s, n: s + n).between(13, 19))
            subs = F.transform(ends, lambda k: F.struct(F.array_join(F.slice(r["g"], i + 1, k), "").alias("s"), k.alias("k")))
            passed = F.filter(subs, lambda x: _luhn(_digits(x["s"])) == 0)
            return F.transform(passed, lambda x: F.struct((-F.length(_digits(x["s"]))).alias("rank"), i.alias("i"), (i + x["k"]).alias("end")))

        found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(r["g"]) - 1), from_group)))
        free = lambda taken, c: ~F.exists(taken, lambda t: (t["i"] < c["end"]) & (c["i"] < t["end"]))
        none = F.array().cast("array<struct<rank:int,i:int,end:int>>")
        taken = F.aggregate(found, none, lambda t, c: F.when(free(t, c), F.concat(t, F.array(c))).otherwise(t))
        return F.transform(F.array(F.array_sort(taken, lambda x, y: x["i"] - y["i"])), lambda t: F.when(F.size(t) > 0, laid(r, t)))[0]

    def laid(r: Column, taken: Column) -> Column:
        def add(s: Column, t: Column) -> Column:
            between = F.array_join(F.slice(r["g"], s["at"] + 1, t["i"] - s["at"]), "")
            card = F.array_join(F.slice(r["g"], t["i"] + 1, t["end"] - t["i"]), "")
            new = F.transform(F.array(card), lambda c: _one_card(c, key, back))[0]
            return F.struct(F.concat(s["text"], between, new).alias("text"), t["end"].alias("at"))

        done = F.aggregate(taken, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), add)
        return F.transform(F.array(done), lambda s: F.struct(F.concat(s["text"], F.array_join(F.slice(r["g"], s["at"] + 1, F.size(r["g"])), "")).alias("text"), F.size(taken).alias("n")))[0]

    return F.transform(F.array(F.regexp_extract_all(m, F.lit(r"[ -]?\d+"), F.lit(0))), pieces)[0]


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code, trunk noughts and layout stay; the national digits are permuted, so that a number is the same in every layout."""
    code = F.regexp_extract(m, rf"^(?:\+{_CODE}(?:[ .-]?\(0\))?|\(?0)", 0)
    rest = F.substr(m, F.length(code) + 1)
    done = F.transform(F.array(_text_permuted(_digits(rest), 10, key, "phone", back)), lambda d: F.concat(code, _laid_out(rest, d)))[0]
    return F.when(F.length(_digits(m)).between(8, 17) & (F.length(_digits(rest)) > 1), done)


def _email(m: Column, key: str, back: bool) -> Column:
    name, host = F.lower(F.substring_index(m, "@", 1)), F.substring_index(m, "@", -1)
    parts = F.regexp_extract_all(name, F.lit("[a-z0-9]{1,24}|[^a-z0-9]+"), F.lit(0))
    return F.concat(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("[a-z0-9]"), _text_permuted(p, 36, key, "email", back)).otherwise(p)), ""), F.lit("@"), host)


def _ip(m: Column, key: str, back: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip", 4, back)
    shown = F.transform(F.array(out), lambda s: F.concat_ws(".", *[F.floor(x / d) % 256 for x in (s["l"], s["r"]) for d in (256, 1)]))[0]
    return F.when(F.forall(o, lambda x: x <= 255) & ~F.exists(F.split(m, r"\."), lambda x: x.rlike("^0.")), shown)


def _date(m: Column, key: str, back: bool) -> Column:
    form = None
    for shape, readings in DATES:
        fits = F.coalesce(*[F.when(F.try_to_timestamp(m, F.lit(r)).isNotNull(), F.lit(r)) for r in readings])
        form = F.when(m.rlike(f"^{shape}$"), fits) if form is None else form.when(m.rlike(f"^{shape}$"), fits)
    side = F.lit(DAY_SIDE).cast("long")

    def moved(n: Column) -> Column:
        out = permute(F.floor(n / DAY_SIDE), (n % DAY_SIDE).cast("long"), side, side, key, "date", 0, back)
        return F.transform(F.array(out), lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * DAY_SIDE + s["r"]).cast("int")))[0]

    def shown(f: Column) -> Column:
        n = F.datediff(F.try_to_timestamp(m, f).cast("date"), F.lit("1900-01-01").cast("date"))
        return F.when(n.between(0, DAY_SIDE * DAY_SIDE - 1), F.call_function("date_format", moved(n), f))

    return F.transform(F.array(form), shown)[0]


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = F.left(m, F.lit(3)).cast("long"), F.substr(m, F.lit(5), F.lit(2)).cast("long"), F.right(m, F.lit(4)).cast("long")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    # valid areas, groups and serials are numbered without gaps: 898 * 99 and 9999
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    out = permute(left, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", 0, back)

    def shown(s: Column) -> Column:
        a = F.floor(s["l"] / 99) + 1
        return F.concat(F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.transform(F.array(out), shown)[0])


_HOW = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn}


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with the text's validated personal data replaced, and counts ``n_email``, ``n_phone``, ``n_ip``,
    ``n_card``, ``n_date`` and ``n_ssn`` of what was. ``key`` is the secret; ``back`` undoes it.

    Dates between 1900-01-01 and 2099-08-04 are moved within them, in their own notation; card numbers keep
    length, layout and a right check digit; phone numbers their layout, country code and trunk nought; e-mail
    addresses their host and the layout of their name, in lower case. (Read back, a date comes out in the first
    notation that its pseudonym can be read in, and a card among other digit groups is found again unless
    groups of its pseudonym and its neighbours pass the check by chance.) Years of two digits are not dates,
    and numbers without a plus, a trunk nought or a North American layout not phones.

    A null text stays null; an empty one empty; texts of any length are searched whole; repeated rows change
    alike; an empty table gives no rows; input columns named like a count give way to it.
    """
    body = F.col("_t")
    rows = docs.select(as_payload(docs), F.col(text).alias("_t"))
    rows = rows.withColumn("_found", F.coalesce(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))

    def kind_of(m: Column) -> Column:
        out = F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{PATTERNS['phone']})$"), "phone").when(m.rlike(f"^(?:{PATTERNS['ip']})$"), "ip")
        return out.when(m.rlike(f"^(?:{PATTERNS['date']})$"), "date").when(m.rlike(f"^(?:{PATTERNS['ssn']})$"), "ssn").otherwise("card")

    def changed(m: Column) -> Column:
        return F.transform(F.array(kind_of(m)), lambda kind: by_kind(m, kind))[0]

    def by_kind(m: Column, kind: Column) -> Column:
        value = F.when(kind == "card", _cards(m, key, back))
        for k, how in _HOW.items():
            value = value.when(kind == k, F.transform(F.array(how(m, key, back)), lambda v: F.struct(v.alias("text"), F.when(v.isNotNull(), 1).otherwise(0).alias("n")))[0])
        return F.transform(F.array(value), lambda v: F.struct(kind.alias("kind"), m.alias("old"), v["text"].alias("new"), F.coalesce(v["n"], F.lit(0)).alias("n")))[0]

    rows = rows.withColumn("_done", F.transform("_found", changed))
    between = F.split(body, ANY, -1)
    pieces = F.zip_with(between, F.transform("_done", lambda d: F.coalesce(d["new"], d["old"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))

    def count(kind: str) -> Column:
        return F.aggregate("_done", F.lit(0).cast("long"), lambda s, d: s + F.when(d["kind"] == kind, d["n"]).otherwise(0))

    outputs = {f"n_{k}": count(k) for k in KINDS}
    # few texts hold any: only theirs are cut up
    fresh = F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(body)
    return with_outputs(rows, docs.columns, {text: fresh, **outputs})
