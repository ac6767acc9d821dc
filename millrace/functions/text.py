"""Text columns: tokens, tags, cleaning, line splitting, path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the line rules.
MAX_LINE_CHARS = 40
COMMA_MARGIN = 15
DIALOGUE_MARK = "-"
TAG_MARK = "#"
NAME_PATTERN = r"[A-Z][a-z]+ [A-Z][a-z]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(_col(text), r"\s+"), lambda t: t != "")


def words(text: Column | str) -> Column:
    r"""Lower-case words between runs of ASCII non-word characters (``\W+``)."""
    return F.filter(F.split(F.lower(_col(text)), r"\W+"), lambda t: t != "")


def hashtags(body: Column | str, mark: str = TAG_MARK) -> Column:
    """Distinct space-separated words that start with the mark."""
    return F.array_distinct(
        F.filter(F.split(_col(body), " "), lambda t: F.startswith(t, F.lit(mark)))
    )


def names(text: Column | str, pattern: str = NAME_PATTERN) -> Column:
    """Distinct matches of a name pattern, in the order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def equals_ignore_case(a: Column | str, b: Column | str) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))


def strip_leading(text: Column | str, chars: str) -> Column:
    return F.ltrim(_col(text), F.lit(chars))


def pad_number(n: Column | str, width: int) -> Column:
    return F.lpad(_col(n).cast("string"), width, "0")


def unescape_unicode(text: Column | str) -> Column:
    r"""Resolve ``\uXXXX`` and the other escapes of a JSON string; null if malformed."""
    # quotes behind an even number of backslashes are bare and get one
    escaped = F.regexp_replace(_col(text), r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    quoted = F.concat(F.lit('{"v":"'), escaped, F.lit('"}'))
    return F.from_json(quoted, "v STRING")["v"]


def clean_line(text: Column | str) -> Column:
    """Drop control characters; a line that starts with a quote loses its first and last character."""
    visible = F.regexp_replace(_col(text), r"[\x00-\x1F]", "")
    inner = F.substring(visible, F.lit(2), F.greatest(F.length(visible) - 2, F.lit(0)))
    return F.when(F.startswith(visible, F.lit('"')), inner).otherwise(visible)


def _halves(text: Column) -> Column:
    parts = F.split(text, " ")
    mid = F.floor(F.size(parts) / 2).cast("int")
    rest = (F.size(parts) - mid).cast("int")
    # slice() counts from 1
    return F.array(
        F.array_join(F.slice(parts, F.lit(1), mid), " "),
        F.array_join(F.slice(parts, mid + 1, rest), " "),
    )


def split_line(
    text: Column | str, max_chars: int = MAX_LINE_CHARS, margin: int = COMMA_MARGIN
) -> Column:
    """One line to an array of lines.

    Short lines stay.  Long ones are cut after their first comma when it is further than
    ``margin`` from both ends, else in half by words.
    """
    t = _col(text)
    comma = F.instr(t, ",") - 1  # 0-based, -1 without a comma
    at_comma = F.array(
        F.substring(t, F.lit(1), comma + 1), F.substring(t, comma + 2, F.length(t))
    )
    usable = (comma > margin) & (comma < F.length(t) - margin)
    return (
        F.when(F.length(t) <= max_chars, F.array(t)).when(usable, at_comma).otherwise(_halves(t))
    )


def split_dialogue(text: Column | str, mark: str = DIALOGUE_MARK) -> Column:
    """Lines of a two-person dialogue, each with its mark again."""
    parts = F.split(_col(text), mark)
    spoken = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(F.filter(spoken, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))


def display_lines(text: Column | str) -> Column:
    """Cleaned text as display lines: dialogue by speaker, other text by length."""
    cleaned = clean_line(text)
    return F.when(
        F.startswith(cleaned, F.lit(DIALOGUE_MARK)), split_dialogue(cleaned)
    ).otherwise(split_line(cleaned))


def plausible_lines(text: Column | str, expected: Column | str) -> Column:
    """Whether the number of non-empty lines is the expected one."""
    lines = F.filter(F.split(_col(text), "\n"), lambda t: t != "")
    return F.size(lines) == _col(expected)


def last_part(text: Column | str, delimiter: str = "/") -> Column:
    return F.substring_index(_col(text), delimiter, -1)


def base_name(path: Column | str) -> Column:
    """Last path part without its suffix."""
    return F.regexp_replace(last_part(path), r"\.[^.]*$", "")


def file_ending(media_type: Column | str) -> Column:
    """``image/png`` to ``png``."""
    return last_part(media_type)


def strip_trailing_separators(segment: Column | str) -> Column:
    return F.regexp_replace(_col(segment), r"\|+$", "")
