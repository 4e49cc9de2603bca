"""Text functions as columns. Matching is on code points; letters are compared without case in all of Unicode."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D


def words(values: Iterable[str]) -> Column:
    """An array literal of the values in lower case."""
    return F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")


def normal_space(x: Column) -> Column:
    """Runs of white space, the unbreakable kind included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def contains_any(x: Column, values: Sequence[str]) -> Column:
    """Whether a value occurs, case ignored: a chain of tests that stays in generated code."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(F.lower(x), F.lit(v.lower()))
    return out


def found_words(x: Column, values: Sequence[str]) -> Column:
    """The values that occur, case ignored, in the order given."""
    every = F.array(*[F.when(F.contains(F.lower(x), F.lit(v.lower())), F.lit(v)) for v in values])
    return F.filter(every, lambda v: v.isNotNull())


def matches_any(x: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern is found anywhere in the text with normal spaces, case ignored."""
    return F.rlike(normal_space(x), F.lit("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)


def has_word(x: Column, word: Column) -> Column:
    """Whether word occurs in x as a whole word, case ignored."""
    return F.rlike(x, F.concat(F.lit(r"(?iuU)\b\Q"), word, F.lit(r"\E\b")))


def project_key(street: Column, number: Column, place: Column, *fallbacks: Column) -> Column:
    """The first that isn't empty of the address and the fallbacks: lower case, letters, digits and spaces alone. The last
    fallback should name the row itself, so that unnamed projects never meet and reruns agree."""
    full = [F.when(p != "", p) for p in (street, number, place)]
    base = F.coalesce(*[F.when(b != "", b) for b in (F.concat_ws(" ", *full), *fallbacks)])
    return normal_space(F.regexp_replace(F.lower(base), r"[^\p{L}\p{M}\p{N}_\s\u00a0]", ""))


def recall_text(x: Column) -> Column:
    """Text for comparison: lower case, one spelling of streets, sharp s, dashes and spaces."""
    x = F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"strasse|str\.", "str")
    return normal_space(F.regexp_replace(x, "[\u2010-\u2015]", "-"))


def recall_pattern(term: Column) -> Column:
    """The pattern of a search term: digits alone are a plan's number; after a last digit none may follow."""
    term = recall_text(term)
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    return (
        F.when(F.rlike(term, F.lit(r"\A\d+\z")), F.concat(F.lit(D.PLAN_PATTERN), term, F.lit(r"(?!\d)")))
        .when(F.rlike(term, F.lit(r"\d\z")), F.concat(quoted, F.lit(r"(?!\d)")))
        .otherwise(quoted)
    )


URL = r"\A\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def url_part(url: Column, part: int) -> Column:
    """1: scheme, 2: authority, 3: path, 4: query; empty if missing."""
    return F.regexp_extract(F.trim(url), URL, part)


def normal_url(url: Column) -> Column:
    """Key of a page: scheme and host in lower case, no fragment, parameters, tracking or empty query parts, no slash at the end."""
    scheme, host = F.lower(url_part(url, 1)), F.lower(url_part(url, 2))
    path = F.regexp_replace(F.regexp_replace(url_part(url, 3), r";[^/]*\z", ""), r"/+\z", "")
    query = F.array_join(F.filter(F.split(url_part(url, 4), "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_"))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path != "", path).otherwise("/"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def domain(url: Column) -> Column:
    """The host in lower case, without user, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(url_part(url, 2)), r"\A.*@|:\d*\z", ""), r"\Awww\.", "")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once even where use's lambdas need it for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def first_number(x: Column, pattern: str, least: int, most: int) -> Column:
    """struct<n int, at int, text string> of the first match of pattern whose group 1, without dots, is from least to most; else null.

    The text is cut at the first k matches, where the k-th is the one: it ends where the rest begins. So its place is its own, whatever stands
    before it and looks alike, and the text is searched three times, however many matches it has.
    """

    def found(text: Column, k: Column, number: Column) -> Column:
        match = F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), k - 1)
        rest = F.get(F.split(text, pattern, k + 1), k)
        return bound(match, lambda m: F.struct(number.alias("n"), (F.length(text) - F.length(rest) - F.length(m) + 1).cast("int").alias("at"), m.alias("text")))

    def first(text: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(n, r"\.", "").cast("int"))
        place = lambda ns: F.array_position(F.transform(ns, lambda n: n.between(least, most)), True).cast("int")
        return bound(numbers, lambda ns: bound(place(ns), lambda k: F.when(k > 0, found(text, k, F.get(ns, k - 1)))))

    return bound(x, first)


def quoted(x: Column, hit: Column) -> Column:
    """What stands around a match of first_number in x, with normal spaces and marks where it is cut; null without a match."""
    start = F.greatest(hit["at"] - D.QUOTE_AROUND, F.lit(1))
    end = F.least(hit["at"] + F.length(hit["text"]) - 1 + D.QUOTE_AROUND, F.length(x))
    quote = F.concat(F.when(start > 1, F.lit("…")).otherwise(""), normal_space(F.substr(x, start, end - start + 1)), F.when(end < F.length(x), F.lit("…")).otherwise(""))
    return F.when(hit.isNotNull(), F.substr(quote, F.lit(1), F.lit(D.QUOTE_MOST)))


def unit_count(x: Column, pattern: str = D.UNIT_PATTERN, bounds: tuple[int, int] = D.UNITS_RANGE) -> Column:
    """struct<units int, quote string>: the first number of homes in bounds, with what stands around it; nulls if there is none."""
    return bound(first_number(x, pattern, *bounds), lambda hit: F.struct(hit["n"].alias("units"), quoted(x, hit).alias("quote")))


def clauses(x: Column, word: str) -> Column:
    """For each place of word in the lower-case text x, its clause: up to 25 signs before and 45 after, cut at stops.

    The text is split at the word once; so many parts as the signs before and after may span are joined again.
    """
    back, on = (-(-n // len(word)) for n in (D.BEFORE, D.AFTER))

    def around(parts: Column) -> Column:
        def clause(i: Column) -> Column:
            first = F.greatest(i - back, F.lit(1))
            before = F.right(F.array_join(F.slice(parts, first, i - first + 1), word), F.lit(D.BEFORE))
            after = F.left(F.array_join(F.slice(parts, i + 1, F.lit(on + 1)), word), F.lit(D.AFTER))
            return F.concat(F.regexp_extract(before, r"[^.,;:!?\n]*\z", 0), F.lit(word), F.regexp_extract(after, r"\A[^.,;:!?\n]*", 0))

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), clause)).otherwise(F.array().cast("array<string>"))

    return bound(F.split(x, rf"\Q{word}\E"), around)


def happened(x: Column, start_words: Sequence[str], future_words: Sequence[str], year: int) -> Column:
    """Whether a start word stands in a clause without a future word and without a year after year."""
    low, out = F.lower(x), F.lit(False)

    def announced(c: Column) -> Column:
        years = F.regexp_extract_all(c, F.lit(r"(?U)\b(20\d\d)\b"), F.lit(1))
        return contains_any(c, future_words) | F.exists(years, lambda y: y.cast("int") > year)

    for word in start_words:
        w = word.lower()
        # The scan of all places is only made where the word occurs at all.
        out = out | F.when(F.contains(low, F.lit(w)), F.exists(clauses(low, w), lambda c: ~announced(c))).otherwise(F.lit(False))
    return out


def phase(x: Column, year: int, start_words: Sequence[str] = D.START_WORDS, permit_words: Sequence[str] = D.PERMIT_WORDS, future_words: Sequence[str] = D.FUTURE_WORDS) -> Column:
    """BAUBEGINN if a start has happened, else BAUGENEHMIGUNG if a permit is named, else null. year: of the day of reference."""
    return F.when(happened(x, start_words, future_words, year), F.lit("BAUBEGINN")).when(contains_any(x, permit_words), F.lit("BAUGENEHMIGUNG"))


def tenure(x: Column, ownership: Sequence[str] = D.OWNERSHIP_WORDS, rent: Sequence[str] = D.RENT_WORDS) -> Column:
    """GEMISCHT, EIGENTUM, MIETE or UNKLAR by which words occur; ownership words in capitals only count at the start of a word."""
    own = contains_any(x, [w for w in ownership if not w.isupper()])
    for w in ownership:
        if w.isupper():
            own = own | F.rlike(x, F.lit(rf"(?iuU)\b{re.escape(w)}"))
    let = contains_any(x, rent)
    return F.when(own & let, F.lit("GEMISCHT")).when(own, F.lit("EIGENTUM")).when(let, F.lit("MIETE")).otherwise(F.lit("UNKLAR"))


def page_marked(pages: Column) -> Column:
    """The pages in one text, each under its number."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[Seite "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def fenced(x: Column, tag: str) -> Column:
    """x between tags of that name, with the same tags inside it made harmless."""
    return F.concat(F.lit(f"<{tag}>\n"), F.regexp_replace(x, rf"(?i)<(/?\s*{re.escape(tag)})", "&lt;$1"), F.lit(f"\n</{tag}>"))


def latin1_safe(x: Column) -> Column:
    """x with a question mark for each sign that Latin-1 lacks; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\x{0}-\x{FF}]", "?")


def filename_safe(x: Column) -> Column:
    """x with underscores for signs that file names shouldn't hold; nothing left is an error."""
    name = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_-]", "_"), r"\A_+|_+\z", "")
    return F.when(name != "", name).otherwise(F.raise_error(F.lit("no file name is left")).cast("string"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def without_session_number(x: Column) -> Column:
    """A committee's name without '(7. Sitzung)' at its end."""
    return F.trim(F.regexp_replace(x, r"(?iU)\s*\(\d+\.\s*Sitzung\)\s*\z", ""))


def trailing_id(x: Column) -> Column:
    """The number at the end of a page's address, null without one."""
    return F.nullif(F.regexp_extract(x, r"-(\d+)/*\z", 1), F.lit(""))


def german_date(x: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(x, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("")), F.lit("dd.MM.yyyy")).cast("date")


def german_time(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\b(\d{1,2}:\d{2})\b", 1), F.lit(""))


def number_shown(x: Column) -> Column:
    """A number without decimals, halves to even; a question mark for null."""
    return F.when(x.isNull(), F.lit("?")).otherwise(F.format_string("%.0f", F.bround(x, 0).cast("double")))


def joined_text(*parts: Column) -> Column:
    """The parts that aren't empty, with a blank line between."""
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])
