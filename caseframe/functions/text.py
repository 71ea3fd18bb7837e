"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.arrays import let

#: White space as in Unicode, with the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_string(c: Column) -> Column:
    """Strip and lower-case."""
    return F.lower(strip(c))


def normalize_text(c: Column) -> Column:
    """Strip, lower-case, and turn every run of white space into one space."""
    return F.regexp_replace(normalize_string(c), r"(?U)[\s\x1c-\x1f]+", " ")


def tokenize(c: Column) -> Column:
    """Runs of letters and digits of any script, in lower case; runs with an underscore are no tokens."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda x: ~x.contains("_"))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of ``n`` tokens; none where there are fewer."""

    def windows(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, windows)


def ngram_cells(t: Column, n: int, cells: int) -> Column:
    """For each window of ``n`` tokens, its cell: a hash below ``cells``."""
    cell = lambda i: F.pmod(F.xxhash64(*[F.get(t, i + j) for j in range(n)]), F.lit(cells)).cast("int")
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), cell)).otherwise(F.array().cast("array<int>"))


def ngrams_where(t: Column, n: int, chosen: Callable[[Column], Column]) -> Column:
    """Those space-joined windows of ``n`` tokens whose number from 0 is chosen."""
    some = F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - n), chosen), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
    return F.when(F.size(t) >= n, some).otherwise(F.array().cast("array<string>"))


def bits(numbers: Iterable[int], limit: int) -> Column:
    """A set of numbers below ``limit`` as a literal array of 64-bit words."""
    words = [0] * (limit // 64 + 1)
    for x in numbers:
        words[x >> 6] |= 1 << (x & 63)
    return F.split(F.lit(",".join(str(w - (w >> 63 << 64)) for w in words)), ",").cast("array<bigint>")


def has_bit(flags: Column, x: Column) -> Column:
    return F.getbit(F.get(flags, F.shiftright(x, 6)), x.bitwiseAND(63)) == 1


def arabic_digits(text: Column, language: Column) -> Column:
    """Arabic-Indic digits where the language is ``ar_msa``."""
    return F.when(language == "ar_msa", F.translate(text, "0123456789", ARABIC_DIGITS)).otherwise(text)


def western_digits(c: Column) -> Column:
    """The distinct ASCII digits of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9])"), 1)))


def has_devanagari(c: Column) -> Column:
    return c.rlike("[ऀ-ॿ]")


def has_arabic(c: Column) -> Column:
    return c.rlike("[؀-ۿ]")


def has_digit(c: Column) -> Column:
    """A digit of the Western, Devanagari or Arabic-Indic kind."""
    return c.rlike("[0-9०-९٠-٩]")


def duration_label(duration: Column, empty: str = "null") -> Column:
    """``"{value} {unit}"``, or ``empty`` where there is none."""
    return F.when(duration.isNull(), F.lit(empty)).otherwise(F.concat_ws(" ", duration["value"].cast("string"), duration["unit"]))


def display_label(c: Column, labels: dict[str, str]) -> Column:
    """Display text of an enumerated value; other values have their underscores as spaces."""
    shown = F.replace(c, F.lit("_"), F.lit(" "))
    for value, label in labels.items():
        shown = F.when(c == value, F.lit(label)).otherwise(shown)
    return shown


def safe_model_name(c: Column) -> Column:
    """Lower case; spaces and slashes to underscores, plus signs in words."""
    named = normalize_string(c)
    for old, new in ((" ", "_"), ("+", "plus"), ("/", "_")):
        named = F.replace(named, F.lit(old), F.lit(new))
    return named


def ratio(part: Column, whole: Column, digits: int | None = None, scale: float = 1.0) -> Column:
    """``scale * part / whole``, 0 where the whole is 0."""
    value = F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(scale) * part / whole)
    return value if digits is None else F.bround(value, digits)
