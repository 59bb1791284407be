"""Personal numbers, dates and addresses under format-preserving pseudonyms.

What a pattern finds and a check confirms (Luhn's digit, octets, days of the month) is permuted within its own
format by a keyed Feistel network: digits stay digits, letters stay letters, separators stay where they are,
checksums hold again. Equal values get equal pseudonyms in every document, different values different ones,
and who has the key can turn them back. Nothing is looked up and nothing is shuffled.

Only Spark's own functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name, whole

ROUNDS = 8

#: Fixed patterns, in the order in which a place in the text is given to one of them.
EMAIL = r"[\p{L}\p{M}\p{N}._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
#: The day first; where that is no day, the month.
DAY_FIRST = r"(?<!\d)\d{2}[./]\d{2}[./]\d{4}(?!\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
#: Groups of digits, 13 digits or more in all; cards are looked for from every group on.
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,}(?!\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
ANY = "|".join((EMAIL, ADDRESS, ISO_DATE, DAY_FIRST, SOCIAL, PHONE, CARD))
KINDS = ("email", "ip", "date", "social", "phone", "card")


def _number(key: str, *parts: Column) -> Column:
    """52 pseudo-random bits from the key and the parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, tweak: Column, back: bool = False) -> Column:
    """A permutation of the longs 0 .. a * b - 1: value = left * b + right; each round adds a keyed function of
    one half to the other, modulo its own size. back=True inverts it."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s: Column, k: Column) -> Column:
        sign = -1 if back else 1
        left = F.pmod(s["l"] + sign * F.pmod(_number(key, tweak, k, F.lit("l"), s["r"]), a), a)
        right = F.pmod(s["r"] + sign * F.pmod(_number(key, tweak, k, F.lit("r"), s["l"]), b), b)
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).cast("long").alias("l"), F.when(even, s["r"]).otherwise(right).cast("long").alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    return F.aggregate(rounds, start, turn, lambda s: (s["l"] * b + s["r"]).cast("long"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D+", "")


def _tens(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A string of 1 to 18 digits as another of its length."""
    n = F.length(digits)
    value = feistel(digits.cast("long"), _tens(F.floor(n / 2)), _tens(n - F.floor(n / 2)), key, F.concat_ws("/", tweak, n.cast("string")), back)
    return F.lpad(value.cast("string"), n, "0")


def _fill(shape: Column, kind: str, with_: Column) -> Column:
    """shape with its characters of the class `kind` replaced, in order, by those of with_, in shape's case."""
    chars = F.split(shape, "")
    chars = F.filter(chars, lambda c: c != "")
    before = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{kind}]+", ""))
    next_ = lambda c, i: (lambda p: F.when(c.rlike("[A-Z]"), F.upper(p)).otherwise(p))(F.substring(with_, before(i) + 1, F.lit(1)))
    put = F.transform(chars, lambda c, i: F.when(c.rlike(f"^[{kind}]$"), next_(c, i)).otherwise(c))
    return F.array_join(put, "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, doubling every second digit from the right, beginning with the one before the last."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(reversed_, one), F.lit(0), lambda s, x: s + x)


#: Digits of a card, the least and the most.
CARD_DIGITS = (13, 19)


def cards_in(x: Column) -> Column:
    """The places of cards in groups of digits, as structs (first, last) of group numbers: from the first group on
    from which so many digits, up to the end of a group, pass Luhn's check; of several the longest; then on behind it."""
    groups = F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def from_(at: Column) -> Column:
        joined = lambda n: F.array_join(F.slice(groups, at + 1, n), "")
        fits = lambda n: (at + n <= F.size(groups)) & F.length(joined(n)).between(*CARD_DIGITS) & (F.pmod(luhn_sum(joined(n)), F.lit(10)) == 0)
        # A group has a digit at least, so no card has more groups than digits.
        return F.array_max(F.filter(F.sequence(F.lit(1), F.lit(CARD_DIGITS[1])), fits))

    def step(state: Column, at: Column) -> Column:
        free = F.element_at(state, -1)["last"].isNull() | (F.element_at(state, -1)["last"] < at)
        found = F.when(free, from_(at))
        return F.when(found.isNotNull(), F.concat(state, F.array(F.struct(at.alias("first"), (at + found - 1).alias("last"))))).otherwise(state)

    # The first entry stands for none, so that there is always a last one.
    start = F.array(F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")))
    found = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step)
    return F.when(F.size(groups) > 0, F.filter(found, lambda s: s["first"].isNotNull())).otherwise(none)


def _pieces(x: Column, spans: Column) -> tuple[Column, Column]:
    """Groups of digits with what stands between them cut at spans: the text before each span and after the last,
    and the text of each span."""
    groups, between = F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(x, F.lit(r"\D+"), F.lit(0))
    # x begins and ends with digits, so group i is followed by separator i.
    all_ = F.zip_with(groups, between, lambda g, b: F.struct(g.alias("g"), F.coalesce(b, F.lit("")).alias("b")))
    text = lambda a, z: F.array_join(F.transform(F.slice(all_, a + 1, F.greatest(z - a + 1, F.lit(0))), lambda s: F.concat(s["g"], s["b"])), "")
    bare = lambda a, z: F.concat(text(a, z - 1), F.get(groups, z))
    ends = F.concat(F.array(F.lit(-1)), F.transform(spans, lambda s: s["last"]))
    starts = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(groups)))
    behind = lambda e: F.when(e >= 0, F.coalesce(F.get(between, e), F.lit(""))).otherwise(F.lit(""))
    gaps = F.zip_with(ends, starts, lambda e, s: F.concat(behind(e), text(e + 1, s - 1)))
    return gaps, F.transform(spans, lambda s: bare(s["first"], s["last"]))


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _cards(x: Column, spans: Column, key: str, back: bool) -> Column:
    """x with its cards under pseudonyms. Where one would make others be found in x, they are taken again: so what is
    found stays in its place, and can be turned back."""

    def turn(v: Column) -> Column:
        gaps, values = _pieces(v, spans)
        return F.array_join(F.zip_with(gaps, F.transform(values, lambda c: _card(c, key, back)), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

    return F.when(F.size(spans) == 0, x).otherwise(walked(x, turn, lambda v: F.to_json(cards_in(v)) == F.to_json(spans)))


def _card(x: Column, key: str, back: bool) -> Column:
    """The first digit (the network) stays, the check digit is made anew."""
    d = _digits(x)
    n = F.length(d)
    body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, F.lit("card"), back))
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _fill(x, "0-9", F.concat(body, check))


def _phone(x: Column, key: str, back: bool) -> Column:
    """The country's code stays: what follows a plus sign up to the next separator."""
    head = F.regexp_extract(x, r"^(\+\d{1,3}(?=[ .\-(])[ .\-]?)?", 0)
    tail = F.substring(x, F.length(head) + 1, F.length(x))
    return F.concat(head, _fill(tail, "0-9", permute_digits(_digits(tail), key, F.lit("phone"), back)))


#: 1800-01-01 begins 400 years of 146,097 = 189 * 773 days.
_EPOCH, _LEFT, _RIGHT = "1800-01-01", 189, 773


def _day_of(x: Column) -> tuple[Column, Column]:
    """(date, whether the month comes first) of a date in one of the three spellings."""
    iso = x.rlike(r"^\d{4}-")
    spelled = lambda m, d: F.try_to_date(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, m, 2), F.substring(x, d, 2)), "yyyy-MM-dd")
    day_first, month_first = F.when(~iso, spelled(4, 1)), F.when(~iso, spelled(1, 4))
    return F.coalesce(F.when(iso, F.try_to_date(x, "yyyy-MM-dd")), day_first, month_first), ~iso & day_first.isNull()


def walked(start: Column, turn, good, most: int = 64) -> Column:
    """start permuted until the result is good: a permutation of the good values, if start is one. turn and good map
    columns; where a tenth of all values or more is good, the walk ends within `most` steps but for one value in 800."""
    first = F.struct(start.alias("v"), F.lit(False).alias("done"))
    step = lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(turn(s["v"])), lambda v: F.struct(v.alias("v"), good(v).alias("done")))[0])
    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step)
    return F.when(out["done"], out["v"]).otherwise(start)


def _date(x: Column, key: str, back: bool) -> Column:
    """Another day of the years 1800 to 2199; digits and separators stay where they are. Where the month must come
    first, it must in the result."""
    iso = x.rlike(r"^\d{4}-")
    date, month_first = _day_of(x)
    epoch = F.lit(_EPOCH).cast("date")
    at = F.datediff(date, epoch).cast("long")
    turn = lambda v: feistel(v, _LEFT, _RIGHT, key, F.lit("date"), back)
    late = walked(at, turn, lambda v: F.dayofmonth(F.date_add(epoch, v.cast("int"))) > 12)
    text = F.date_format(F.date_add(epoch, F.when(month_first, late).otherwise(turn(at)).cast("int")), "yyyy-MM-dd")
    a, b = (F.when(month_first, F.substring(text, i, 2)).otherwise(F.substring(text, j, 2)) for i, j in ((6, 9), (9, 6)))
    return F.when(iso, text).otherwise(F.concat(a, F.substring(x, 3, 1), b, F.substring(x, 6, 1), F.substring(text, 1, 4)))


def _ip(x: Column, key: str, back: bool) -> Column:
    o = F.split(x, r"\.")
    value = sum((F.get(o, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(o, F.lit(0)).cast("long") * 256**3)
    new = feistel(value, 65536, 65536, key, F.lit("ip"), back)
    return F.concat_ws(".", *[F.pmod(F.floor(new / 256 ** (3 - i)), F.lit(256)).cast("string") for i in range(4)])


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _email(x: Column, key: str, back: bool) -> Column:
    """Letters and digits of the part before @, each in its place, in its case: a letter moves by a keyed
    number that depends on the address's form (digits and letters permuted apart); the domain stays."""
    local = F.regexp_extract(x, r"^[^@]+", 0)
    rest = F.substring(x, F.length(local) + 1, F.length(x))
    letters = F.lower(F.regexp_replace(local, r"[^A-Za-z]+", ""))
    n = F.length(letters)
    # Twelve letters at a time are one number below 26 ** 12.
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 12).cast("int"), F.lit(0))), lambda i: F.substring(letters, i * 12 + 1, F.lit(12)))
    value = lambda c: F.aggregate(F.filter(F.split(c, ""), lambda s: s != ""), F.lit(0).cast("long"), lambda v, s: (v * 26 + F.instr(F.lit(_LETTERS), s) - 1).cast("long"))
    power = lambda k: F.round(F.pow(F.lit(26.0), k)).cast("long")

    def spelled(v: Column, k: Column) -> Column:
        places = F.sequence(k - 1, F.lit(0), F.lit(-1))
        return F.array_join(F.transform(places, lambda p: F.substring(F.lit(_LETTERS), F.pmod(F.floor(v / power(p)), F.lit(26)).cast("int") + 1, F.lit(1))), "")

    def other(c: Column, i: Column) -> Column:
        k = F.length(c)
        half = F.floor(k / 2)
        tweak = F.concat_ws("/", F.lit("email"), rest, i.cast("string"), k.cast("string"))
        return F.when(k == 0, F.lit("")).otherwise(spelled(feistel(value(c), power(half), power(k - half), key, tweak, back), k))

    new = F.array_join(F.transform(chunks, other), "")
    digits = F.regexp_replace(local, r"[^0-9]+", "")
    # Eighteen digits at a time are one number.
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(digits) - 1) / 18).cast("int"), F.lit(0))), lambda i: F.substring(digits, i * 18 + 1, F.lit(18)))
    tweak = lambda i: F.concat(F.lit("email"), rest, F.when(i > 0, i.cast("string")).otherwise(F.lit("")))
    moved = F.array_join(F.transform(runs, lambda d, i: F.when(d == "", F.lit("")).otherwise(permute_digits(d, key, tweak(i), back))), "")
    return F.concat(_foreign(_fill(_fill(local, "A-Za-z", new), "0-9", moved), rest, key, back), rest)


#: Small letters of other alphabets, each permuted within its own: Latin with marks, Greek, Cyrillic.
ALPHABETS = tuple("".join(c for c in map(chr, range(a, b + 1)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c) for a, b in ((0xE0, 0x17F), (0x3AC, 0x3CE), (0x430, 0x45F)))


def _foreign(local: Column, rest: Column, key: str, back: bool) -> Column:
    """Letters of ALPHABETS, each moved by a keyed number of its place and the domain; letters of other scripts stay."""
    chars = F.filter(F.split(local, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        small = F.lower(c)
        out = c
        for letters in ALPHABETS:
            at = F.instr(F.lit(letters), small)
            by = F.pmod(_number(key, F.lit("letter"), rest, i), F.lit(len(letters)))
            new = F.substring(F.lit(letters), (F.pmod(at - 1 + (-by if back else by), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            out = F.when(at > 0, F.when(c == small, new).otherwise(F.upper(new))).otherwise(out)
        return out

    return F.when(local.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(chars, one), "")).otherwise(local)


def _is_issued(d: Column) -> Column:
    """Whether nine digits can be a social number."""
    return ~d.startswith("000") & ~d.startswith("666") & ~d.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _social(x: Column, key: str, back: bool) -> Column:
    """Another number that can be issued."""
    return _fill(x, "0-9", walked(_digits(x), lambda d: permute_digits(d, key, F.lit("social"), back), _is_issued))


def kind_of(x: Column) -> Column:
    """The kind whose check x passes, or null; card for groups of digits that may hold some (see cards_in)."""
    octets = F.split(x, r"\.")
    real = F.forall(octets, lambda o: o.cast("int").between(0, 255) & ((F.length(o) == 1) | ~o.startswith("0")))
    iso = x.rlike(f"^(?:{ISO_DATE})$")
    day, _ = _day_of(x)
    in_years = day.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date"))
    d = _digits(x)
    is_ = lambda p: x.rlike(f"^(?:{p})$")
    return (
        F.when(is_(EMAIL), F.lit("email"))
        .when(is_(ADDRESS) & real, F.lit("ip"))
        .when((iso | is_(DAY_FIRST)) & in_years, F.lit("date"))
        .when(is_(SOCIAL) & _is_issued(d), F.lit("social"))
        .when(is_(PHONE) & F.length(d).between(7, 15), F.lit("phone"))
        .when(is_(CARD), F.lit("card"))
    )


def pseudonym(x: Column, kind: Column, key: str, back: bool = False) -> Column:
    """x within its format; x itself if kind is null."""
    makers = {"email": _email, "ip": _ip, "date": _date, "social": _social, "phone": _phone, "card": _card}
    out = F.when(kind == KINDS[0], makers[KINDS[0]](x, key, back))
    for name in KINDS[1:]:
        out = out.when(kind == name, makers[name](x, key, back))
    return out.otherwise(x)


def pseudonymise(df: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """df with its text under pseudonyms, n_found (long), and found: an array of (kind, value, pseudonym).

    A null text stays null and has none; whole texts are searched, whatever their length. Repeated rows and
    equal values get equal pseudonyms. Columns named found or n_found are replaced. back=True restores texts
    that were made with the key. Of an address's name, letters of scripts without a place in ALPHABETS stay. Other
    columns keep their values, whatever their names.
    """
    df = df.drop("found", "n_found")
    hits, parts = free_name(df, "_hits"), free_name(df, "_parts")
    body = whole(text)
    # Most texts have none; only the others are cut up.
    df = df.withColumn(hits, F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    kinds = free_name(df, "_kinds")
    df = df.withColumn(kinds, F.transform(hits, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value"))))
    # A hit is gaps and values in turn: most are one value between empty gaps; groups of digits may hold several cards, or none.
    entry = lambda k, v, p: F.struct(k.alias("kind"), v.alias("value"), p.alias("pseudonym"))
    hit = lambda gaps, values: F.struct(gaps.alias("gaps"), values.alias("values"))
    nothing = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")

    def cut(s: Column) -> Column:
        k, v = s["kind"], s["value"]
        one = hit(F.array(F.lit(""), F.lit("")), F.array(entry(k, v, pseudonym(v, k, key, back))))
        return F.when(k.isNull(), hit(F.array(v), nothing)).when(k == "card", _bound(cards_in(v), lambda spans: cards(v, spans))).otherwise(one)

    def cards(v: Column, spans: Column) -> Column:
        gaps, values = _pieces(v, spans)
        new = _pieces(_cards(v, spans, key, back), spans)[1]
        return hit(gaps, F.zip_with(values, new, lambda a, b: entry(F.lit("card"), a, b)))

    df = df.withColumn("found", F.transform(kinds, cut))
    df = df.withColumn(parts, F.when(F.size(hits) > 0, F.split(body, ANY)))
    spelled = lambda f: F.array_join(F.zip_with(f["gaps"], f["values"], lambda g, v: F.concat(g, F.coalesce(v["pseudonym"], F.lit("")))), "")
    new = F.array_join(F.zip_with(parts, F.col("found"), lambda p, f: F.concat(p, F.coalesce(spelled(f), F.lit("")))), "")
    df = df.withColumn(text, F.when(F.size(hits) > 0, new).otherwise(F.col(text)))
    df = df.withColumn("found", F.flatten(F.transform("found", lambda f: f["values"])))
    return df.withColumn("n_found", F.size("found").cast("long")).drop(hits, parts, kinds)


#: The key of the query; a real key is a secret of whoever calls pseudonymise.
QUERY_KEY = "lodeworks-example-key"


def query(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
    return out.select("doc_id", "text", "n_found", "found")
