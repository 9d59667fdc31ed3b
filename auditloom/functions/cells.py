"""Reading cells: the three blanks, typed reading that keeps the raw value, shapes and comparable forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexical natures and the full-match patterns of their texts, in the order that breaks ties.
NATURES = {
    "date_dmy": (r"\d{2}/\d{2}/\d{4}", "date", "dd/MM/yyyy"),
    "date_ymd": (r"\d{8}", "date", "yyyyMMdd"),
    "date_iso": (r"\d{4}-\d{2}-\d{2}", "date", "yyyy-MM-dd"),
    "time_hm": (r"([01]\d|2[0-3]):[0-5]\d", "minutes", None),
    "integer": (r"-?\d+", "integer", None),
    "decimal_comma": (r"-?\d+,\d+", "decimal", None),
    "decimal_point": (r"-?\d+\.\d+", "decimal", None),
}
#: Horizontal white space: tab, blank, no-break and the other Unicode spaces.
SPACE = r"\h"
DECIMAL = "decimal(28,8)"


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | c.cast("string").rlike(r"^[\s\h\x85\u2028\u2029]*\z")


def full_match(c: Column, pattern: str) -> Column:
    """The whole text matches; a final line feed isn't passed over."""
    return c.cast("string").rlike(rf"^(?:{pattern})\z")


def read(c: Column, nature: str) -> Column:
    """struct(value, state): state is read, blank or unreadable, and the raw value is left alone.

    Natures of text never raise: an impossible date or number is unreadable.
    """
    pattern, family, form = NATURES[nature]
    text = c.cast("string")
    fits = full_match(text, pattern)
    if family == "date":
        value = F.when(fits, F.try_to_timestamp(text, F.lit(form)).cast("date"))
    elif family == "minutes":
        value = F.when(fits, F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))
    elif family == "integer":
        value = F.when(fits, text.try_cast("bigint"))
    else:
        value = F.when(fits, F.replace(text, F.lit(","), F.lit(".")).try_cast(DECIMAL))
    state = F.when(blank(c), "blank").when(value.isNull(), "unreadable").otherwise("read")
    return F.struct(value.alias("value"), state.alias("state"))


def nature_of(c: Column) -> Column:
    """The first nature whose reading succeeds, else ``text``; null for a blank."""
    out = F.when(blank(c), None)
    for name in NATURES:
        out = out.when(read(c, name)["state"] == "read", name)
    return out.otherwise("text")


def signature(c: Column) -> Column:
    """The shape of a text: capitals A, other letters a, digits 9, all else as it is."""
    text = F.regexp_replace(c.cast("string"), r"\p{Lu}", "A")
    return F.regexp_replace(F.regexp_replace(text, r"[\p{L}&&[^\p{Lu}]]", "a"), r"\p{Nd}", "9")


#: What Unicode takes for white space, with the separators of old data streams.
WHITE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _folds() -> tuple[str, str, str]:
    """(letters, what they become one for one, pattern of letters that become several); combining marks, which go, end the first."""
    import sys
    import unicodedata

    one, several, gone = [], [], []
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if not form:
            gone.append(c)
        elif len(form) > 1:
            several.append(i)
        elif form != c:
            one.append((c, form))
    edges = [k for k in range(len(several)) if k == 0 or several[k] != several[k - 1] + 1] + [len(several)]
    spans = "".join(rf"\x{{{several[a]:x}}}-\x{{{several[b - 1]:x}}}" for a, b in zip(edges, edges[1:], strict=False) if several[a] != 0xDF)
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), rf"[\x{{80}}-\x{{10ffff}}&&[{spans}]]"


FOLDED, FOLDS, SEVERAL = _folds()


def normalise(c: Column) -> Column:
    """Compatibility decomposition without combining marks, case folded, runs of white space as one blank, trimmed.

    Texts of ASCII alone, whose bytes are as many as their characters, only need
    lower case; most others are folded letter by letter. Those with letters that
    become several (ligatures, fractions, Hangul; sharp s apart) are decomposed
    by the JVM's Unicode library.
    """
    text = c.cast("string")
    apart = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    whole = F.try_reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.translate(apart, FOLDED, FOLDS), F.lit(True))
    letters = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), FOLDED, FOLDS)
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).when(text.rlike(SEVERAL), whole).otherwise(letters)
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def number(c: Column) -> Column:
    """As a double; null, and no error, where a text is none."""
    return c.try_cast("double")


def amount(c: Column) -> Column:
    """As a decimal of eight places; null, and no error, where a text is none."""
    return c.try_cast(DECIMAL)


def day(c: Column) -> Column:
    """As a date; null, and no error, where a text is none."""
    return c.try_cast("date")


def comparable(c: Column, how: str = "as_is") -> Column:
    """A text for comparison: ``as_is``, ``normalised`` or ``words`` (normalised, in any order)."""
    if how == "as_is":
        return c.cast("string")
    if how == "normalised":
        return normalise(c)
    if how == "words":
        return F.array_join(F.array_sort(F.split(normalise(c), " ")), " ")
    raise ValueError(f"no comparison called {how}")


def tidy_spaces(c: Column) -> Column:
    """Runs of horizontal space become one blank; none is left at the ends. Line breaks stay."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), r"^ +| +\z", "")


def bad_spaces(c: Column) -> Column:
    return c.isNotNull() & (tidy_spaces(c) != c)


def differs(x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """Numbers whose difference, rounded to nine places, is over the tolerance."""
    return F.abs(F.round(number(x) - number(y), 9)) > F.lit(tolerance)


def luhn(c: Column) -> Column:
    """True or false for texts of digits, null for others."""
    return F.when(full_match(c, "[0-9]+"), F.call_function("luhn_check", c.cast("string")))


def sql_name(name: str) -> str:
    """A plain identifier: no marks, words split at capitals, everything else an underscore."""
    import re
    import unicodedata

    plain = "".join(x for x in unicodedata.normalize("NFKD", name) if not unicodedata.combining(x))
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", plain)
    return re.sub(r"[^a-z0-9]+", "_", split.lower()).strip("_")
