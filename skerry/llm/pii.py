"""Personal data by patterns, checksums and context words, natively.

Regular expressions propose spans; Luhn (cards), mod-97 (IBANs) and range or
length checks confirm them; words near a span raise its score. Everything is
made of DataFrame functions: Spark has no function that returns match
positions, so a text is split by the same pattern and the lengths of pieces
and matches are added up. Lengths count code points.

The patterns are written so that every one runs in time linear in the text:
possessive repeats, and a look-behind that lets a match begin only where a run
of its characters begins. They find the same leftmost, non-overlapping spans
as the plain forms quoted beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MADE = ("n_email", "n_ip", "n_card", "n_phone", "found")

# The length of an IBAN by country, as registered under ISO 13616.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT",
    26: "IS TR",
    27: "FR GR IT MC MR SM",
    28: "AL AZ CY DO GT HU LB PL",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
}


def _iban_pattern() -> str:
    """Country, check digits and exactly as much account as the country has."""
    forms = (
        f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}"
        for length, countries in IBAN_LENGTHS.items()
    )
    return f"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: kind -> (Java pattern, text that must occur for a match or None), in output order.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; \G: right after a match.
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", "."),
    # [0-9]([ -]?[0-9])+ of 13 to 19 digits: whole runs only.
    "card": (
        r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
        None,
    ),
    # \+[0-9][ ().0-9-]+[0-9]
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    # Added by this method: country, check digits and account of an IBAN.
    "iban": (_iban_pattern(), None),
    # Added by this method: a social-security number, only with a context word.
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}

BASE = ("email", "ip", "card", "phone")

#: kind -> score of a confirmed span without context words.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}

#: kind -> words that raise the score when they stand near the span.
CONTEXT = {
    "email": "e-?mail|mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": "ssn|social security|tax|taxpayer",
}

CONTEXT_BONUS = 0.2
CONTEXT_CHARS = 40
#: Spans of the added kinds count from this score on; base kinds always.
THRESHOLD = 0.5


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def total(digits: Column) -> Column:
        n = F.length(digits)

        def add(acc: Column, i: Column) -> Column:
            d = digits.substr(n - i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return acc + F.when(i % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    return _let(_digits(match), total) % 10 == 0


def _mod97(match: Column) -> Column:
    def rest(plain: Column) -> Column:
        turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))

        def add(acc: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c)))

    return _let(F.regexp_replace(match, " ", ""), rest) == 1


def _ip_parts(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _phone_digits(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


CHECKS = {"ip": _ip_parts, "card": _luhn, "phone": _phone_digits, "iban": _mod97}


def _spans(body: Column, kind: str) -> Column:
    """Confirmed spans of one kind as array<struct<kind,start,end,score>>."""
    pattern, needs = PATTERNS[kind]
    pattern_col = F.lit(pattern)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def lengths(texts: Column) -> Column:
        return F.transform(texts, lambda t: F.length(t).cast("long"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def starts(part: Column) -> Column:
        """Start of each match: the lengths of all pieces and matches before it."""

        def in_blocks(t: Column) -> Column:
            # t: steps (a piece and the match after it), width of a block.
            width = t["width"]

            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((F.size(t["steps"]) - 1) / width).cast("int")),
                lambda k: total(F.slice(t["steps"], k * width + 1, width)),
            )

            def from_blocks(sums: Column) -> Column:
                before = F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
                return _let(
                    before,
                    lambda known: F.transform(
                        part["sizes"],
                        lambda _, i: F.get(known, F.floor(i / width).cast("int"))
                        + total(F.slice(t["steps"], F.floor(i / width).cast("int") * width + 1, i % width))
                        + F.get(part["gaps"], i),
                    ),
                )

            return _let(blocks, from_blocks)

        n = F.size(part["sizes"])
        steps = F.zip_with(F.slice(part["gaps"], F.lit(1), n), part["sizes"], lambda g, m: g + m)
        width = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
        return _let(F.struct(steps.alias("steps"), width.alias("width")), in_blocks)

    def context(part: Column, i: Column) -> Column:
        """The match with up to ``CONTEXT_CHARS`` code points on either side, taken
        from the pieces and matches next to it: two pieces and a match each."""

        def end(text: Column) -> Column:
            return F.right(F.coalesce(text, F.lit("")), F.lit(CONTEXT_CHARS))

        def begin(text: Column) -> Column:
            return F.left(F.coalesce(text, F.lit("")), F.lit(CONTEXT_CHARS))

        pieces, matches = part["pieces"], part["matches"]
        left = end(F.concat(end(F.get(pieces, i - 1)), end(F.get(matches, i - 1)), end(F.get(pieces, i))))
        right = begin(F.concat(begin(F.get(pieces, i + 1)), begin(F.get(matches, i + 1)), begin(F.get(pieces, i + 2))))
        return F.concat(left, F.get(matches, i), right)

    def confirmed(matches: Column) -> Column:
        part = F.struct(matches.alias("matches"), F.split(body, pattern, -1).alias("pieces"))

        def measured(p: Column) -> Column:
            return F.struct(
                p["matches"].alias("matches"), p["pieces"].alias("pieces"),
                lengths(p["pieces"]).alias("gaps"), lengths(p["matches"]).alias("sizes"),
            )

        def located(p: Column) -> Column:
            def span(start: Column, i: Column) -> Column:
                match = F.get(p["matches"], i)
                near = F.lower(context(p, i))
                bonus = F.when(near.rlike(rf"(?U)\b(?:{CONTEXT[kind]})\b"), CONTEXT_BONUS).otherwise(0.0)
                right = CHECKS[kind](match) if kind in CHECKS else F.lit(True)
                return F.when(
                    right,
                    F.struct(
                        F.lit(kind).alias("kind"),
                        start.alias("start"),
                        (start + F.length(match)).alias("end"),
                        (F.lit(SCORES[kind]) + bonus).alias("score"),
                    ),
                )

            return F.transform(starts(p), span)

        spans = _let(_let(part, measured), located)
        least = 0.0 if kind in BASE else THRESHOLD
        spans = F.filter(spans, lambda s: s.isNotNull() & (s["score"] >= least))
        return F.when(F.size(matches) > 0, spans).otherwise(none)

    found = _let(F.regexp_extract_all(body, pattern_col, F.lit(0)), confirmed)
    return found if needs is None else F.when(body.contains(needs), found).otherwise(none)


def find_pii(
    docs: DataFrame, *, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Find personal data in every whole text of ``docs``.

    Adds ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``found``: spans
    ``(kind, start, end, score)`` by kind as in ``PATTERNS``, then by start, in
    code points, end exclusive, to the columns ``carry`` (all, if None).

    Defined cases: a null text counts as empty; an empty text has no spans;
    long texts are searched as a whole, in time n ** 1.5 for n matches of a
    kind; spans of different kinds may overlap; repeated rows each get their
    own result; an empty table gives no rows; input columns named like an
    output column are left out, other names are free.
    """
    own = common.Own(docs, carry, MADE)
    staged = docs.select(*own.staged, F.coalesce(common.named(text), F.lit("")).alias("body"))
    staged = staged.select(*own.names, F.concat(*(_spans(F.col("body"), k) for k in PATTERNS)).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return staged.select(*own.restored, *map(count, BASE), "found")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts, digest of the base spans, all spans."""

    def listed(spans: Column) -> Column:
        return F.concat_ws(
            ",",
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        )

    found = find_pii(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in BASE),
        F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
