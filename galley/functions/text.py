"""Text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import rules


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often ``use`` needs it."""
    return F.get(F.transform(F.array(value), use), 0)


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, or null; rows are neither added nor lost."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


# All white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(x, F.lit(SPACES))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def literal(word: str) -> str:
    """A regular expression for a word's characters."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in word)


#: All descriptors in one pass, longer ones first. Taking them out one after the other gives the
#: same: where two of them overlap one is the end of the other, and what is left of a name has two
#: spaces where a word was, so no new phrase comes up.
STRIP_PATTERN = r"(?U)\b(?:" + "|".join(literal(w) for w in sorted(rules.STRIP_WORDS, key=lambda w: -len(w))) + r")\b"


def normalize_name(name: Column) -> Column:
    """An ingredient's name for merging: lower case, without notes, descriptors and punctuation, aliases resolved."""
    x = F.replace(strip(F.lower(name)), F.lit("-"), F.lit(" "))
    x = F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", ""), STRIP_PATTERN, "")
    x = strip(F.regexp_replace(F.regexp_replace(x, "[,;]+", ""), r"(?U)\s+", " "))
    first = bind(x, lambda n: F.coalesce(lookup(rules.NAME_ALIASES, n), n))
    bare = lambda n: strip(F.regexp_replace(n, "(?U)" + rules.TRAILING_WORDS, ""))
    return bind(first, lambda n: F.coalesce(lookup(rules.NAME_ALIASES, bare(n)), n))


def _trimmed_unit(unit: Column) -> Column:
    return F.regexp_replace(strip(F.lower(unit)), r"\.+$", "")


def normalize_unit(unit: Column) -> Column:
    """A unit's usual spelling; none is ""."""
    return F.coalesce(bind(_trimmed_unit(unit), lambda u: F.coalesce(lookup(rules.UNIT_ALIASES, u), u)), F.lit(""))


def unit_grams(unit: Column) -> Column:
    """Grams of a unit in nutrition."""
    return F.coalesce(lookup(rules.GRAMS_PER_UNIT, _trimmed_unit(unit)), F.lit(rules.DEFAULT_GRAMS))


def categorize(name: Column) -> Column:
    """A grocery category: of the last word that is a keyword, else of a phrase in the name, else Misc."""
    known = rules.keyword_categories()
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", ""), "[,;/]+", " ")

    def of(text: Column) -> Column:
        words = F.transform(F.reverse(F.split(strip(text), r"(?U)\s+")), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
        by_word = F.get(F.filter(F.transform(words, lambda w: lookup(known, w)), lambda c: c.isNotNull()), 0)
        by_phrase = F.lit(None).cast("string")
        for phrase, category in reversed([(k, c) for k, c in known.items() if " " in k]):
            by_phrase = F.when(F.contains(text, F.lit(phrase)), category).otherwise(by_phrase)
        return F.coalesce(by_word, by_phrase, F.lit("Misc"))

    return bind(clean, of)


def join_parts(*parts: Column, separator: str = " ") -> Column:
    """The parts that aren't empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def plural(count: Column) -> Column:
    return F.when(count != 1, "s").otherwise("")


def escape_html(x: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def label(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def position_percent(x: Column) -> Column:
    """The vertical percentage of a picture's position; 50 without one."""
    return F.coalesce(F.regexp_extract(x, r"([\d.]+)%", 1).try_cast("double"), F.lit(50.0))


def clamp_percent(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def doubtful(confidence: Column) -> Column:
    """Whether an amount was read with less than high confidence."""
    return F.coalesce(confidence.isin("low", "medium"), F.lit(False))


def instruction_lines(text: Column) -> Column:
    """Instructions as an array of lines: one long line is split before its numbers, "Step N:" becomes "N.)"."""
    filled = lambda lines: F.filter(lines, lambda x: F.length(strip(x)) > 0)
    lines = filled(F.split(text, "\n"))
    split = filled(F.split(text, r"(?i)(?=\d+\.\)|Step\s+\d+)"))
    chosen = F.when((F.size(lines) <= 1) & (F.length(text) > 100), split).otherwise(lines)
    return F.transform(chosen, lambda x: F.regexp_replace(strip(x), r"(?iU)^Step\s+(\d+)[:.]\s*", "$1.) "))


def section_title(line: Column) -> Column:
    """The title in a line like "-- Dressing --", or null."""
    return F.nullif(F.regexp_extract(line, r"(?U)^-{2,}\s*(.+?)\s*-{2,}$", 1), F.lit(""))


def int_or(x: Column, default: int) -> Column:
    """The integer at the start of a text; without one, or for 0, the default."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(default))
