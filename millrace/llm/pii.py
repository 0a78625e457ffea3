"""Personal data found by patterns, confirmed by checksums, weighed by context.

Everything is a Spark expression over one text: no Python runs on the executors
and nothing is shuffled. A pattern's matches come from ``regexp_extract_all`` and
the text between them from ``split`` with the same pattern; the lengths of both
give positions in code points.

The patterns are the contract's, written with possessive quantifiers and a check
of the character before: the same matches, found in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Kinds in the contract's order, patterns, and context words.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")
PATTERNS = {
    "email": (
        "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
    ),
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": (
        "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?"
        "(?![A-Za-z0-9])"
    ),
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Texts without a match of these hold no span of the kind.
GATES = {
    "email": "@",
    "ip": "[0-9]\\.[0-9]",
    "card": "[0-9][\\x20-]?[0-9]",
    "phone": "\\+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}[\\x20A-Z0-9]",
    "ssn": "[0-9]{3}-[0-9]{2}-",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
WORDS_FOR = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|credit|debit|payment|amex",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|transfer|konto",
    "ssn": "ssn|social|security|taxpayer",
}
WORDS_AGAINST = {
    "email": "example|noreply",
    "ip": "version|release|section|build",
    "card": "isbn|order|tracking|serial|sample",
    "phone": "sample|extension",
    "iban": "sample|serial",
    "ssn": "part|order|serial|sample",
}
NEAR = 40
THRESHOLD = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits pass the Luhn sum; every second from the right counts double."""
    figures = F.split(F.reverse(_digits(match)), "")

    def value(figure: Column, place: Column) -> Column:
        n = F.coalesce(F.try_to_number(figure, F.lit("9")).cast("int"), F.lit(0))
        twice = n * 2
        return F.when(place % 2 == 0, n).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(figures, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    """Whether an account number, its first four signs moved to the end, leaves 1."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return (
            F.when(sign == "", rest)
            .when(code <= 57, (rest * 10 + code - 48) % 97)
            .otherwise((rest * 100 + code - 55) % 97)
        )

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, "\\."), small)


def _figures_between(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: _figures_between(m, 12, 19) & _luhn(m),
    "phone": lambda m: _figures_between(m, 9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(
        F.concat(F.right(before, F.lit(NEAR)), F.lit("\n"), F.left(after, F.lit(NEAR)))
    )
    score = (
        F.lit(SCORES[kind])
        + F.when(near.rlike(f"\\b({WORDS_FOR[kind]})\\b"), 0.2).otherwise(0.0)
        - F.when(near.rlike(f"\\b({WORDS_AGAINST[kind]})\\b"), 0.3).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 2)


def _pairs(text: Column, kind: str) -> Column:
    """Every match with the text before it, up to the last match, and the text behind it."""
    between = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    held = text.rlike(GATES[kind])
    return F.arrays_zip(
        F.when(held, F.slice(between, F.lit(1), F.size(matches))).otherwise(none).alias("before"),
        F.when(held, matches).otherwise(none).alias("match"),
        F.when(held, F.slice(between, F.lit(2), F.size(matches))).otherwise(none).alias("after"),
    )


def _ends(pairs: Column) -> Column:
    """Where each match ends.

    Appending to an array copies it, so sums run within blocks of as many matches as there
    are blocks, and over the blocks.
    """
    width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
    zero = F.lit(0)

    def running(values: Column) -> Column:
        first = F.struct(zero.alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))

        def add(state: Column, n: Column) -> Column:
            at = state["at"] + n
            return F.struct(at.alias("at"), F.concat(state["ends"], F.array(at)).alias("ends"))

        return F.aggregate(values, first, add)

    def block(b: Column) -> Column:
        some = F.slice(pairs, b * width + 1, width)
        return running(F.transform(some, lambda p: F.length(p["before"]) + F.length(p["match"])))

    count = F.ceil(F.size(pairs) / F.greatest(width, F.lit(1))).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(zero, count - 1), block))
    sums = F.transform(blocks, lambda x: x["at"])
    shifted = F.zip_with(
        blocks, running(sums)["ends"], lambda x, total: F.transform(x["ends"], lambda e: e + total - x["at"])
    )
    return F.coalesce(F.flatten(shifted), F.expr("cast(array() as array<int>)"))


def _spans(pairs: Column, ends: Column, kind: str, order: int) -> Column:
    """Array of (start, order, end, kind, value, score) of the confirmed spans."""

    def span(pair: Column, end: Column) -> Column:
        return F.struct(
            (end - F.length(pair["match"])).alias("start"),
            F.lit(order).alias("order"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            pair["match"].alias("value"),
            _score(kind, pair["before"], pair["after"]).alias("score"),
        )

    def held(found: Column) -> Column:
        sure = CONFIRM[kind](found["value"])
        return sure & (found["score"] >= THRESHOLD) if kind in EXTRA_KINDS else sure

    return F.filter(F.zip_with(pairs, ends, span), held)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: every confirmed span, by start and then by kind.

    A span has ``start``, ``end`` (code points, end exclusive), ``kind``,
    ``value`` and ``score``. Kinds of the contract are always kept and only
    scored; further kinds (``iban`` by mod 97, ``ssn`` by number rules) are kept
    from a score of 0.5. A null text is empty and has no spans. Rows are neither
    dropped nor merged; a column named ``pii`` in ``docs`` is replaced. Equal spans of a text
    all count. A long text with ``n`` matches of a kind takes time in proportion to its length
    and to ``n`` times the root of ``n``.
    """
    kinds = (*BASE_KINDS, *EXTRA_KINDS)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    pairs = [_pairs(F.col("_pii_text"), k).alias(f"_pairs_{k}") for k in kinds]
    found = docs.select(*kept, whole_text(text).alias("_pii_text")).select(*kept, *pairs)
    ends = [_ends(F.col(f"_pairs_{k}")).alias(f"_ends_{k}") for k in kinds]
    found = found.select(*kept, *[f"_pairs_{k}" for k in kinds], *ends)
    columns = [
        _spans(F.col(f"_pairs_{k}"), F.col(f"_ends_{k}"), k, i).alias(f"_pii_{k}")
        for i, k in enumerate(kinds)
    ]
    found = found.select(*kept, *columns)
    return found.select(*kept, F.array_sort(F.concat(*[f"_pii_{k}" for k in kinds])).alias("pii"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
        ),
        ",",
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document, as the contract names them."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    lowest = F.array_min(F.transform("pii", lambda s: s["score"]))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        lowest.alias("lowest_score"),
    )
