"""Text functions as columns: normalization, comparison, language, script, suspicious characters.

A normalization policy is a plan-time constant that generates one expression.
Everything is JVM-side except Unicode normalization forms, which Spark has no
function for and which run as an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits by policy, character variants, zero-width characters.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
VARIANTS = {"\u064a": "\u06cc", "\u0649": "\u06cc", "\u0643": "\u06a9", "\u0629": "\u0647"}
TATWEEL = "\u0640"
NON_JOINER = "\u200c"
ZERO_WIDTH = "\u061c\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
#: White space as Python's str.isspace sees it (Java's \s, even with (?U), leaves out U+001C to U+001F).
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same as characters, for functions that take a set of them.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pattern of tokens whose digits are kept: addresses, separated codes and dates, alphanumeric identifiers.
PROTECTED = (
    r"(?U)(?:(?i:\b(?:https?://|ftp://|www\.)[^\s<>()]+)"
    r"|(?<![\w.+-])[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
    r"|(?<!\w)(?=[A-Za-z0-9٠-٩۰-۹:/._+-]*\d)[A-Za-z0-9٠-٩۰-۹]+(?:[-/:._][A-Za-z0-9٠-٩۰-۹]+)+(?!\w)"
    r"|(?<!\w)(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]+(?!\w))"
)
RIGHT_TO_LEFT = "[\u0590-\u08ff]"
ARABIC_LETTERS = "[\u0600-\u06ff]"
LATIN_LETTERS = "[A-Za-z]"

#: Characters that words can be numbered by: four bytes each, from F0000000 to F4FFFFFF.
CODES = 5 << 24

_CHOICES = {
    "unicode_form": ("NFC", "NFKC", "NFD", "NFKD"),
    "digits": ("preserve", "persian", "arabic", "ascii"),
    "whitespace": ("preserve", "trim", "collapse"),
    "line_breaks": ("preserve", "space", "remove"),
    "zero_width": ("preserve", "preserve_non_joiner", "remove"),
}


@dataclass(frozen=True)
class Normalization:
    """Policy of ``normalize``.  ``unicode_form`` None leaves the form alone, which keeps the plan JVM-side."""

    unicode_form: str | None = "NFC"
    variants: bool = True
    digits: str = "persian"
    remove_tatweel: bool = False
    whitespace: str = "trim"
    line_breaks: str = "preserve"
    zero_width: str = "preserve"
    trim_edges: bool = True

    def __post_init__(self) -> None:
        for name, allowed in _CHOICES.items():
            value = getattr(self, name)
            if value not in allowed and not (name == "unicode_form" and value is None):
                raise ValueError(f"invalid {name}: {value!r}")


DEFAULT = Normalization()
BUILTIN = Normalization(unicode_form=None)


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """The text in a Unicode normalization form (Arrow UDF)."""
    return each_text(text, lambda x: x if x.isascii() else unicodedata.normalize(form, x))


#: Texts of a batch that are Python strings at once.
HELD = 64


def each_text(text: Column, f: Callable[[str], str]) -> Column:
    """``f`` of every text that is not null (Arrow UDF): a worker holds a batch as Arrow, and few of its texts as strings."""

    @F.arrow_udf(T.StringType())
    def apply(texts: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, len(texts), HELD):
            parts.append(pa.array([None if x is None else f(x) for x in texts.slice(k, HELD).to_pylist()], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return apply(text)


def strip(text: Column) -> Column:
    """Without white space at either end, as Python's strip."""
    return F.btrim(text, F.lit(SPACES))


def map_digits(text: Column, policy: str) -> Column:
    """Decimal digits of the three scripts in the policy's script.

    With ``arabic``, Arabic-Indic digits stay as they are (mapping them to ASCII would not be idempotent).
    """
    if policy == "preserve":
        return text
    target = {"persian": PERSIAN_DIGITS, "arabic": ARABIC_DIGITS, "ascii": ASCII_DIGITS}[policy]
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS + ASCII_DIGITS, target * 3)


def map_unprotected_digits(text: Column, policy: str) -> Column:
    """``map_digits`` outside protected tokens: the pieces between them are mapped, and all joined again."""
    if policy == "preserve":
        return text
    pieces = F.split(text, PROTECTED, -1)
    tokens = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    joined = F.zip_with(pieces, tokens, lambda p, t: F.concat(map_digits(p, policy), F.coalesce(t, F.lit(""))))
    # Splitting compiles the pattern for every row: texts without a digit go round it.
    return F.when(text.rlike(f"[{ASCII_DIGITS}{ARABIC_DIGITS}{PERSIAN_DIGITS}]"), F.array_join(joined, "")).otherwise(text)


def line_breaks(text: Column, policy: str) -> Column:
    """Line breaks as LF; kept, made spaces, or removed."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    return unified if policy == "preserve" else F.translate(unified, "\n", " " if policy == "space" else "")


def zero_width(text: Column, policy: str) -> Column:
    if policy == "preserve":
        return text
    return F.translate(text, ZERO_WIDTH.replace(NON_JOINER, "") if policy == "preserve_non_joiner" else ZERO_WIDTH, "")


def normalize(text: Column, policy: Normalization = DEFAULT) -> Column:
    """Normalized text; the raw text is a column of its own and never replaced.

    Order: form, line breaks, zero-width characters, variants, tatweel, digits, white space, edges.
    """
    out = text if policy.unicode_form is None else unicode_form(text, policy.unicode_form)
    out = zero_width(line_breaks(out, policy.line_breaks), policy.zero_width)
    if policy.variants:
        out = F.translate(out, "".join(VARIANTS), "".join(VARIANTS.values()))
        if policy.remove_tatweel:
            out = F.translate(out, TATWEEL, "")
    out = map_unprotected_digits(out, policy.digits)
    if policy.whitespace == "collapse":
        out = F.regexp_replace(out, f"{SPACE}+", " ")
    return strip(out) if policy.trim_edges or policy.whitespace == "trim" else out


def cer_like(left: Column, right: Column) -> Column:
    """Edit distance to the longer length; 0 for two empty texts.  Both in NFC already."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(left, right) / longer)


def compare(left: Column, right: Column, nfc: bool = True) -> Column:
    """How two raw texts differ: a struct of equalities, distances and the kinds of difference.

    Equality after normalization uses the default policy, whatever a caller's own is.
    """
    policy = DEFAULT if nfc else BUILTIN
    a, b = (unicode_form(x) if nfc else x for x in (left, right))
    digit = r"\d²³¹⁰⁴-⁹₀-₉"

    def differences(v: Column) -> Column:
        without = lambda pattern: F.regexp_replace(v.na, pattern, "") == F.regexp_replace(v.nb, pattern, "")
        only = lambda x: F.regexp_replace(x, rf"(?U)[^{digit}]", "")
        differ = v.na != v.nb
        punctuation, space = without(r"\p{P}"), without(SPACE)
        return F.struct(
            v.exact.alias("exact"),
            (v.a == v.b).alias("unicode_equal"),
            (v.na == v.nb).alias("normalized_equal"),
            F.levenshtein(v.a, v.b).alias("edit_distance"),
            cer_like(v.a, v.b).alias("cer_like"),
            (differ & (only(v.na) != only(v.nb)) & without(rf"(?U)[{digit}]")).alias("digit_only"),
            (differ & punctuation & ~space).alias("punctuation_only"),
            (differ & space & ~punctuation).alias("whitespace_only"),
        )

    na, nb = normalize(left, policy), normalize(right, policy)
    return let(F.struct(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb"), (left == right).alias("exact")), differences)


def cer(predicted: Column, reference: Column) -> Column:
    """Edit distance to the reference's length: 0 for two empty texts, 1 where only the reference is empty."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(predicted, reference) / n)


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def wer(predicted: Column, reference: Column) -> Column:
    """Word error rate, JVM-side: distinct words become private characters, whose edit distance is the words'.

    There are ``CODES`` such characters; a pair of texts with more distinct words fails rather than share one.
    """
    p, r = words(predicted), words(reference)

    def rate(pair: Column) -> Column:
        text = lambda a: F.array_join(F.transform(a, lambda w: F.element_at(pair.codes, w)), "")
        n = F.size(pair.r)
        return F.when(n == 0, F.when(F.size(pair.p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(text(pair.p), text(pair.r)) / n)

    known = F.array_distinct(F.concat(r, p))
    enough = lambda k: F.when(F.size(k) <= CODES, k).otherwise(F.raise_error(F.lit("too many distinct words")))
    codes = let(known, lambda k: F.map_from_arrays(enough(k), F.transform(k, lambda _, i: _private(i + 1))))
    return let(F.struct(p.alias("p"), r.alias("r"), codes.alias("codes")), rate)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _private(number: Column) -> Column:
    """A character of its own for each number from 1 to ``CODES``: four bytes from F0000000 on, of no meaning outside a comparison."""
    return F.unhex(F.hex(F.lit(0xF0000000) + number.cast("long") - 1)).cast("string")


def suspicious_rate(text: Column, allow: str = "") -> Column:
    """Share of suspicious characters (replacement, control, format, private, unassigned) of those not white space.

    ``allow`` lists characters that are never suspicious, such as the non-joiner.
    """
    visible = F.regexp_replace(F.translate(text, allow, "") if allow else text, SPACE, "")
    odd = F.length(F.regexp_replace(visible, r"[^\p{C}\x{FFFD}]", ""))
    kept = F.length(F.regexp_replace(text, SPACE, ""))
    return odd / F.greatest(kept, F.lit(1))


def infer_language(text: Column) -> Column:
    """fa, en, fa+en or und, by the scripts present."""
    rtl, latin = text.rlike(ARABIC_LETTERS), text.rlike(LATIN_LETTERS)
    return F.when(rtl & latin, "fa+en").when(rtl, "fa").when(latin, "en").otherwise("und")


def infer_script(text: Column) -> Column:
    rtl, latin = text.rlike(ARABIC_LETTERS), text.rlike(LATIN_LETTERS)
    return F.when(rtl & latin, "Arabic+Latin").when(rtl, "Arabic").when(latin, "Latin").otherwise("Unknown")


def script_consistent(text: Column, language: Column, script: Column) -> Column:
    """Whether the text has a letter of the script that its language or script asks for."""
    rtl, latin = text.rlike(RIGHT_TO_LEFT), text.rlike(LATIN_LETTERS)
    lang, name = F.lower(language), F.lower(script)
    needs_rtl = lang.isin("fa", "fas", "ar", "ara", "ur", "he") | name.isin("arabic", "hebrew")
    needs_latin = lang.isin("en", "eng", "fr", "de", "es", "latin") | name.isin("latin", "latn")
    return ~((needs_rtl & ~rtl) | (needs_latin & ~latin))


def direction(rtl_letters: Column, latin_letters: Column) -> Column:
    """ltr, rtl or mixed from the numbers of letters: mixed where both occur."""
    return F.when((rtl_letters > 0) & (latin_letters > 0), "mixed").when(rtl_letters > 0, "rtl").otherwise("ltr")


def count_matching(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def label_value(name: str, text: Column) -> Column:
    """The value after ``name``, a colon or dash, ignoring case; null where the text has no such label."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in name)
    found = F.regexp_extract(text, rf"(?iU){quoted}\s*[:：-]\s*(\S(?:.*\S)?)$", 1)
    return F.nullif(found, F.lit(""))
