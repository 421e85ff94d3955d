"""Text expressions: tokens, sentences, passages, n-grams. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode-aware equivalent of the pattern \w+.
WORD = r"[\p{L}\p{N}_]+"


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens in order, duplicates kept; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct tokens, by term.

    Tokens are sorted and runs of equal ones measured, so a text is counted
    inside its row, in n log n steps and without a shuffle.
    """

    def runs(words: Column) -> Column:
        def changes(i: Column) -> Column:
            return ~F.get(words, i).eqNullSafe(F.get(words, i - 1))

        def sizes(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(words))
                return F.struct(F.get(words, start).alias("term"), (end - start).cast("long").alias("tf"))

            return F.transform(starts, run)

        # The last place of the sequence lies behind the words, so an empty text has one, too.
        places = F.slice(F.sequence(F.lit(0), F.size(words)), F.lit(1), F.size(words))
        return bound(F.filter(places, changes), sizes)

    return bound(F.sort_array(tokens), runs)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_token(token: Column) -> Column:
    return F.lower(F.trim(token))


def normalize_spaces(text: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Stripped, non-blank sentences: cut at white space after ``.``, ``!`` or ``?``."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+", -1)
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")


def passage_windows(sents: Column, size: int = 10, least: int = 3, overlap: int = 2) -> Column:
    """Windows of ``size`` sentences that share ``overlap`` with the one before.

    The window starts have a closed form, so no loop over sentences is needed;
    a last, partial window stays if it has ``least`` sentences.
    """
    if size <= 0 or least <= 0 or overlap < 0 or least > size:
        raise ValueError("need size >= least > 0 and overlap >= 0")
    overlap = min(overlap, size)
    step = size - overlap if overlap < size else size
    n = F.size(sents)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda w: F.slice(sents, w * step + 1, F.lit(size)))
    kept = F.filter(cut, lambda p: F.size(p) >= least)
    return F.transform(kept, lambda p: F.array_join(p, " "))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams for n in low..high, shorter ones first, joined by a blank."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")

    def of(words: Column, n: int) -> Column:
        if n == 1:
            return words
        at = F.sequence(F.lit(0), F.size(words) - n)
        grams = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    # Bound: else the text would be tokenised again for every n-gram.
    return bound(tokens, lambda words: F.concat(*(of(words, n) for n in range(low, high + 1))))


def overlap_count(tokens: Column, wanted: Column) -> Column:
    """Occurrences in ``tokens`` of any member of ``wanted``."""
    return F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t)))


def stored_text(contents: Column, raw: Column) -> Column:
    """Contents, else a text field of the raw JSON, else the raw string, else empty."""

    def filled(x: Column) -> Column:
        return F.when(x != "", x)

    return F.coalesce(
        filled(contents),
        filled(F.get_json_object(raw, "$.contents")),
        filled(F.get_json_object(raw, "$.raw")),
        filled(raw),
        F.lit(""),
    )


def six_places(x: Column) -> Column:
    """``%.6f`` with exact binary ties to even, as C and Python print them."""
    return F.format_string("%.6f", F.bround(x, 6))
