"""Text normalisation, display and byte encodings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base letters and combining marks that are composed, ligatures and their letters.
MARKS = {
    "̈": ("aoueiy", "äöüëïÿ"),
    "̀": ("aeiou", "àèìòù"),
    "́": ("aeiouycnsz", "áéíóúýćńśź"),
    "̂": ("aeiou", "âêîôû"),
    "̃": ("ano", "ãñõ"),
    "̊": ("au", "åů"),
    "̌": ("cenrsz", "čěňřšž"),
    "̧": ("cs", "çş"),
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: What Windows-1252 has at 0x80 to 0x9F; the five gaps are not assigned.
WINANSI_HIGH = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
INVISIBLE = r"[\p{Cc}­​-‏⁠﻿]"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


#: What makes a normalised text differ from the lower-case one: blanks that aren't single, marks, ligatures, long lower forms.
UNEVEN = r"(?U)\s\s|[^\S ]|[\u0300-\u030C\u0327\uFB00-\uFB06\u0130]"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def ligature_letters(char: Column) -> Column:
    """The letters of a ligature; null for any other character."""
    return F.try_element_at(_map(LIGATURES), char)


def composed(base: Column, mark: Column) -> Column:
    """The lower-case letter that a letter and a combining mark make; null for other pairs."""
    pairs = {base + mark: one for mark, (bases, ones) in MARKS.items() for base, one in zip(bases, ones, strict=True)}
    return F.try_element_at(_map(pairs), F.concat(F.lower(base), mark))


def pieces(text: Column) -> Column:
    """What each character of a text becomes when it is normalised; a mark that was composed becomes nothing."""
    chars = F.split(text, "")

    def piece(c: Column, k: Column) -> Column:
        before, after = F.when(k > 0, F.get(chars, k - 1)), F.get(chars, k + 1)
        blank = c.rlike(r"(?U)^\s$")
        return (
            F.when(blank & F.coalesce(before.rlike(r"(?U)^\s$"), F.lit(False)), "")
            .when(blank, " ")
            .when(composed(before, c).isNotNull(), "")
            .otherwise(F.coalesce(composed(c, after), ligature_letters(c), F.lower(c)))
        )

    return F.transform(chars, piece)


def expand_ligatures(text: Column) -> Column:
    out = text
    for letter, letters in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return F.when(text.rlike(r"[\uFB00-\uFB06]"), out).otherwise(text)


def fold(text: Column) -> Column:
    """Without white space and invisible characters, ligatures as letters: for comparing two renderings of one text."""
    return expand_ligatures(F.regexp_replace(squeeze(text), INVISIBLE, ""))


def drop_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one blank, marks composed, ligatures as letters."""
    plain = F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))
    return F.when(text.rlike(UNEVEN), F.array_join(pieces(text), "")).otherwise(plain)


def needle(text: Column) -> Column:
    return F.trim(normalize(text))


def safe_text(text: Column) -> Column:
    r"""Control and direction characters as ``\u{..}``."""
    unsafe = r"[\p{Cc}؜​-‏ -‮⁠-⁤⁦-⁯﻿]"
    code = lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(unsafe), code(c)).otherwise(c)), "")
    return F.when(text.rlike(unsafe), escaped).otherwise(text)


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^ -~]", ".")


def to_winansi(text: Column) -> Column:
    """The Windows-1252 bytes of a text, characters outside it as ``?``."""
    known = F.regexp_replace(text, f"[^\\x00-\\xFF{WINANSI_HIGH}]", "?")
    return F.encode(F.translate(known, WINANSI_HIGH, "".join(map(chr, range(0x80, 0xA0)))), "ISO-8859-1")


def from_winansi(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINANSI_HIGH)


def pdf_string(data: Column) -> Column:
    """A PDF text string: UTF-16 or UTF-8 by its mark, else Latin (the positions where the two Latin tables agree)."""
    head = F.hex(F.substring(data, 1, 3))
    return (
        F.when(head.startswith("FEFF"), F.decode(F.substring(data, 3, 1 << 30), "UTF-16BE"))
        .when(head.startswith("FFFE"), F.decode(F.substring(data, 3, 1 << 30), "UTF-16LE"))
        .when(head == "EFBBBF", F.decode(F.substring(data, 4, 1 << 30), "UTF-8"))
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def variants(text: Column) -> Column:
    """The byte forms under which a text may stand in a file, as upper-case hex: UTF-8, Windows-1252, UTF-16 both ways."""
    fits = text.rlike(f"^[\\x00-\\x7F\\xA0-\\xFF{WINANSI_HIGH}]*$")
    forms = F.array(F.hex(F.encode(text, "UTF-8")), F.when(fits, F.hex(to_winansi(text))), F.hex(F.encode(text, "UTF-16BE")), F.hex(F.encode(text, "UTF-16LE")))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))
