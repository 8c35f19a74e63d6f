"""Personal data spans, with DataFrame functions only.

Regular expressions propose spans; checksum validators confirm them (Luhn for cards, mod 97 for bank account
numbers, value ranges for addresses); words near a span move its score. Four kinds have fixed patterns and are
reported whenever their validator agrees: email, ip, card, phone. The others (``iban``, ``national``, ``ssn``, ``secret``) are
reported if their score, raised by context words within ``NEAR`` characters before or after the span and lowered by words
before it that name ordinary numbers, reaches ``THRESHOLD``. An account number has the length that its country gives it.
Of the context, at most ``RUN`` matches of the kind on either side are looked through.

Spans come from splitting a text at the matches of a pattern: the lengths of the parts and of the matches add up
to the places, in code points, of the leftmost matches that do not overlap. Patterns use possessive quantifiers
and look-behind, so that a text of any length is scanned in linear time without recursion.

Defined cases: a null text is empty; an empty text has no spans; null and repeated ids are carried through; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of an account number by country: fixed values of the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
EXTRA = {
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "national": r"(?<![0-9+A-Za-z.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/-])",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|mailto|write)",
    "ip": r"(?i)\b(?:ip|address|host|server|client)",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)",
    "national": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact)",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer)",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|credential|bearer)",
}
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|part|model|serial|ticket)\b"
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "national": 0.35, "ssn": 0.35, "secret": 0.35}
BOOST, PENALTY, NEAR, THRESHOLD = 0.25, 0.2, 40, 0.5
RUN = 6
BLOCK = 64


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _ip_parts(c: Column) -> Column:
    """Every part at most 255; leading zeros don't count."""
    return F.forall(
        F.split(c, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
    )


def _mod97(c: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count from 10, the rest by 97 is 1."""
    plain = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda x: x != "")
    value = lambda x: F.when(x >= "A", F.ascii(x) - 55).otherwise(F.ascii(x) - 48)
    rest = F.aggregate(chars, F.lit(0), lambda acc, x: (acc * F.when(x >= "A", 100).otherwise(10) + value(x)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


VALID = {
    "email": lambda c: F.lit(True),
    "ip": _ip_parts,
    "card": lambda c: F.length(_digits(c)).between(13, 19) & F.call_function("luhn_check", _digits(c)),
    "phone": lambda c: F.length(_digits(c)).between(9, 15),
    "iban": _mod97,
    "national": lambda c: F.lit(True),
    "ssn": lambda c: ~F.substring(c, 1, 3).isin("000", "666") & (F.substring(c, 1, 1) < "9") & (F.substring(c, 5, 2) != "00") & (F.substring(c, 8, 4) != "0000"),
    "secret": lambda c: F.regexp_like(c, F.lit("[0-9].*[0-9]")) & F.regexp_like(c, F.lit("[A-Za-z].*[A-Za-z]")) & (F.size(F.array_distinct(F.split(c, ""))) >= 8),
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def _block(a: Column) -> Column:
    """Elements of a block: the square root of their number, ``BLOCK`` at least."""
    return F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(a)))).cast("int")


def _blocks(a: Column) -> Column:
    """0 .. the number of blocks less one."""
    return F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _block(a)).cast("int"))


def _places(out: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds starts_<kind>: prefix sums of the lengths of parts and matches, by blocks and within a block, so
    that a text of n matches takes some n * sqrt(n) additions (n * BLOCK for a few thousand) and no growing array."""
    some = lambda k, c: F.when(F.col(f"gaps_{k}").isNotNull(), c)
    step = lambda k: F.zip_with(f"found_{k}", F.slice(f"gaps_{k}", 1, F.size(f"found_{k}")), lambda m, g: F.length(m) + F.length(g))
    out = out.select("*", *[some(k, step(k)).alias(f"steps_{k}") for k in kinds])
    part = lambda k, b: F.slice(f"steps_{k}", b * _block(F.col(f"steps_{k}")) + 1, _block(F.col(f"steps_{k}")))
    sums = lambda k: F.transform(_blocks(F.col(f"steps_{k}")), lambda b: _sum(part(k, b)))
    offs = lambda k: F.transform(f"sums_{k}", lambda _, b: _sum(F.slice(f"sums_{k}", F.lit(1), b)))
    out = out.select("*", *[some(k, sums(k)).alias(f"sums_{k}") for k in kinds])
    out = out.select("*", *[some(k, offs(k)).alias(f"offs_{k}") for k in kinds])

    def starts(k: str) -> Column:
        def within(off: Column, b: Column) -> Column:
            own = part(k, b)
            return F.transform(own, lambda x, i: off + _sum(F.slice(own, F.lit(1), i)) + F.length(F.get(F.col(f"gaps_{k}"), b * _block(F.col(f"steps_{k}")) + i)))

        return F.flatten(F.transform(f"offs_{k}", within))

    return out.select("*", *[some(k, starts(k)).alias(f"starts_{k}") for k in kinds])


def _near(out: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds before_<kind> and after_<kind>: the ``NEAR`` characters on either side of each match, put together from parts and matches."""
    near, some = F.lit(NEAR), lambda k, c: F.when(F.col(f"gaps_{k}").isNotNull(), c)
    lead = lambda k: F.zip_with(F.slice(f"gaps_{k}", 1, F.size(f"found_{k}")), f"found_{k}", lambda g, m: F.concat(F.right(g, near), m))
    tail = lambda k: F.zip_with(f"found_{k}", F.slice(f"gaps_{k}", 2, F.size(f"found_{k}")), lambda m, g: F.concat(m, F.left(g, near)))
    out = out.select("*", *[some(k, lead(k)).alias(f"lead_{k}") for k in kinds], *[some(k, tail(k)).alias(f"tail_{k}") for k in kinds])

    def before(k: str) -> Column:
        return F.transform(f"lead_{k}", lambda x, i: F.right(F.concat(F.array_join(F.slice(f"lead_{k}", F.greatest(i - RUN, F.lit(0)) + 1, F.least(i, F.lit(RUN))), ""), F.right(F.get(F.col(f"gaps_{k}"), i), near)), near))

    def after(k: str) -> Column:
        return F.transform(f"tail_{k}", lambda x, i: F.left(F.concat(F.left(F.get(F.col(f"gaps_{k}"), i + 1), near), F.array_join(F.slice(f"tail_{k}", i + 2, F.lit(RUN)), "")), near))

    return out.select("*", *[some(k, before(k)).alias(f"before_{k}") for k in kinds], *[some(k, after(k)).alias(f"after_{k}") for k in kinds])


def _spans(kind: str) -> Column:
    """array<struct<kind, start, end, score>> of a kind's valid matches."""

    def scored(m: Column) -> Column:
        said = F.regexp_like(m["before"], F.lit(CONTEXT[kind])) | F.regexp_like(m["after"], F.lit(CONTEXT[kind]))
        score = F.lit(BASE_SCORE[kind]) + F.when(said, BOOST).otherwise(0.0) - F.when(F.regexp_like(m["before"], F.lit(AGAINST)), PENALTY).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score")
        )

    columns = {"start": "starts", "match": "found", "before": "before", "after": "after"}
    matches = F.arrays_zip(*[F.col(f"{c}_{kind}").alias(name) for name, c in columns.items()])
    return F.transform(F.filter(matches, lambda m: VALID[kind](m["match"])), scored)


#: A cheap test that every text with a match of the kind passes.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.regexp_like(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")),
    "national": lambda t: F.regexp_like(t, F.lit(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
    "ssn": lambda t: F.regexp_like(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    "secret": lambda t: F.regexp_like(t, F.lit(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}")),
}


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and a column of spans (kind, start, end, score) for every kind."""
    kinds = {**PATTERNS, **EXTRA}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    text = F.col("text")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the columns are used several times below, so Spark keeps them in a projection of their own
    out = out.select("doc_id", "text", *[F.when(_MAY[k](text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"found_{k}") for k, p in kinds.items()])
    out = out.select("*", *[F.when(F.size(f"found_{k}") > 0, F.split(text, p, -1)).alias(f"gaps_{k}") for k, p in kinds.items()])
    out = _near(_places(out, [*kinds]), [*kinds])
    spans = []
    for kind in kinds:
        all_spans = _spans(kind)
        told = all_spans if kind in PATTERNS else F.filter(all_spans, lambda s: s["score"] >= threshold)
        spans.append(F.when(F.col(f"gaps_{kind}").isNotNull(), told).otherwise(none).alias(kind))
    return out.select("doc_id", *spans)


def joined(kinds: list[str], score: bool = False) -> Column:
    """kind:start:end (and score) of all spans of the kinds, in their order, joined by commas."""
    said = lambda s: F.concat_ws(":", s["kind"], *[s[x].cast("string") for x in ("start", "end", "score")[: 2 + score]])
    return F.array_join(F.concat(*[F.transform(F.col(k), said) for k in kinds]), ",")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and text with every span replaced by <KIND>; of spans that overlap the first goes, then the longest."""
    pair = docs.select(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t")).alias("pair"), F.col(text_col).alias("t"))
    found = find_spans(pair, "pair", "t", threshold).withColumnRenamed("doc_id", "pair")
    kinds = [*PATTERNS, *EXTRA]
    text = F.coalesce(F.col("pair.t"), F.lit(""))
    order = F.array_sort(F.transform(F.concat(*map(F.col, kinds)), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct((-s["e"]).alias("at"), piece.alias("out"))).otherwise(acc)

    done = F.aggregate(order, first, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.select(F.col("pair.i").alias("doc_id"), done.alias("text"))
