"""Scalar text functions as column expressions.

What Spark has no built-in for (Unicode composition and case folding) is an Arrow UDF that sees
only the values that are not plain ASCII; the others stay in the JVM.
"""

from __future__ import annotations

import ctypes
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Python's white space, as a Java character class.
_SPACE = r"(?U)[^\s\x1c-\x1f]+"
_ASCII = r"^\p{ASCII}*$"
_ISO_FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd HH:mm:ssXXX", "yyyyMMdd",
)


def give_back() -> None:
    """What is freed goes back to the system: Python workers stay for later tasks, whatever these need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else unicodedata.normalize("NFC", t) for t in (s.as_py() for s in texts)), pa.string())


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else unicodedata.normalize("NFC", t).casefold() for t in (s.as_py() for s in texts)), pa.string())


def _beyond_ascii(text: Column, plain: Column, other) -> Column:
    ascii_ = text.rlike(_ASCII)
    return F.when(ascii_, plain).otherwise(other(F.when(~ascii_, text)))


def composed(text: Column) -> Column:
    """Unicode composition (NFC)."""
    return _beyond_ascii(text, text, _nfc)


def normalise(text: Column) -> Column:
    """NFC, then full case folding; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return _beyond_ascii(text, F.lower(text), _folded)


def fold(text: str | None) -> str:
    """``normalise`` of a driver-side value."""
    return unicodedata.normalize("NFC", text or "").casefold()


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_SPACE)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores; vowel signs part words."""
    return F.regexp_extract_all(composed(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def url_path(url: Column) -> Column:
    """The path without query, fragment and last-segment parameters; never fails."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def slug_words(url: Column) -> Column:
    """The path's letters and digits (a-z, 0-9), everything else as single spaces."""
    return F.regexp_replace(F.lower(url_path(url)), "[^a-z0-9]+", " ")


def slug(name: Column) -> Column:
    """A name as a file or key name; empty if it has no Latin letters or digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def page_key(url: Column) -> Column:
    """The name under which a page is cached."""
    return F.substring(F.sha2(url, 256), 1, 32)


def parse_time(text: Column) -> Column:
    """ISO 8601 to a timestamp; blank or other forms are null; without zone it is in the session's."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in _ISO_FORMS]
    guarded = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    return F.coalesce(guarded, *[F.when(t.rlike(r"^\d{4}-?\d{2}-?\d{2}"), x) for x in tries])


def minute(published: Column) -> Column:
    """``yyyy-MM-dd HH:mm``, or empty."""
    return F.coalesce(F.date_format(published, "yyyy-MM-dd HH:mm"), F.lit(""))


#: Month names of the report's window, from January on.
MONTHS = "जानेवारी फेब्रुवारी मार्च एप्रिल मे जून जुलै ऑगस्ट सप्टेंबर ऑक्टोबर नोव्हेंबर डिसेंबर".split()


def window_text(start: Column, end: Column) -> Column:
    """Two ``MM/dd/yyyy`` dates spelled out with an ISO pair; anything else as it is."""

    def spelled(day: Column) -> Column:
        return F.concat_ws(" ", F.dayofmonth(day), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day))

    a, b = (F.try_to_timestamp(x, F.lit("MM/dd/yyyy")).cast("date") for x in (start, end))
    both = F.concat(
        spelled(a), F.lit(" ते "), spelled(b), F.lit(" ("), F.date_format(a, "yyyy-MM-dd"), F.lit(" – "), F.date_format(b, "yyyy-MM-dd"), F.lit(")")
    )
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.concat(start, F.lit(" – "), end))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unfenced(text: Column) -> Column:
    """Without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*\n?|\n?```\s*$", ""))


def template_safe(text: Column) -> Column:
    """Braces doubled, so that a template takes them literally."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
