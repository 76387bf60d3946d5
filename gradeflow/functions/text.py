"""Text expressions that follow Python's Unicode rules rather than Java's ASCII defaults."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes and its \s matches.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
# Python's \w, and its \b spelled out as look-arounds on either side of a word character.
WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
# The same as WORD_START but placed after the word's first character, which is cheaper to test first.
STARTS_WORD = rf"(?<!{WORD}.)"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# The mark of a cut text, and where an answer stands, in order of preference.
TRUNCATED = "\n[truncated]"
MARKED_ANSWER = rf"####{WS}*([^\n]+)"
TAGGED_ANSWER = rf"(?is)<answer>{WS}*(.*?){WS}*</answer>"
BOXED_ANSWER = r"\\boxed\{([^{}]+)\}"
NUMBER_ANSWER = r"-?\p{Nd}+(?:\.\p{Nd}+)?"
LETTER_ANSWER = f"{WORD_START}([A-D]){WORD_END}"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or(value: Column | str | None, default: str = "") -> Column:
    """A column read as text: no column gives ``default``, a null gives the empty string."""
    if value is None:
        return F.lit(default)
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(SPACES))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def count_words(value: Column) -> Column:
    return F.regexp_count(value, F.lit(f"{NOT_WS}+"))


def has_words(value: Column, count: int) -> Column:
    """Whether there are at least ``count`` words, reading no further than that many."""
    return value.rlike(rf"\A{WS}*+(?:{NOT_WS}++{WS}++){{{count - 1}}}{NOT_WS}")


def without_commas(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(""))


def all_matches(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def last_match(value: Column, pattern: str, group: int = 1) -> Column:
    """The last match of ``pattern``, null where there is none."""
    return F.try_element_at(all_matches(value, pattern, group), F.lit(-1))


def first_match(value: Column, pattern: str, group: int = 1) -> Column:
    """The first match of ``pattern``; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def contains_any(value: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | value.contains(needle)
    return found


def trim_text(value: Column, limit: int) -> Column:
    """Strip, squeeze blank lines, and cut what is over ``limit`` back to a line end."""
    tidy = F.regexp_replace(strip(value), r"\n{3,}", "\n\n")
    cut = F.regexp_replace(F.substring(tidy, 1, limit), r"\n[^\n]*\z", "")
    return F.when(F.length(tidy) <= limit, tidy).otherwise(F.concat(cut, F.lit(TRUNCATED)))


def normalize(value: Column, restrip: bool = True) -> Column:
    """Comparison form of an answer: no commas, single spaces, lower case.

    ``restrip=False`` leaves a space that removing a comma exposed at either end.
    """
    single = F.regexp_replace(without_commas(strip(text_or(value))), f"{WS}+", " ")
    return F.lower(strip(single) if restrip else single)


def extract_answer(value: Column, letters: bool = True) -> Column:
    """The final answer in a response: marker, tag, box, number, option letter, or all of it."""
    text = text_or(value)
    steps = [
        strip(last_match(text, MARKED_ANSWER)),
        strip(last_match(text, TAGGED_ANSWER)),
        strip(last_match(text, BOXED_ANSWER)),
        last_match(without_commas(text), NUMBER_ANSWER, 0),
    ]
    if letters:
        steps.append(last_match(F.upper(text), LETTER_ANSWER))
    return F.coalesce(*steps, strip(text))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")


def stamped_name(name: Column, middle: str, at: Column) -> Column:
    """``<safe name>-<middle>-<UTC stamp>``; the session time zone must be UTC."""
    return F.concat_ws("-", safe_name(name), F.lit(middle), utc_stamp(at))


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def fill_template(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places; braces inside the filled-in values are left alone."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in values:
                raise ValueError(f"template names an unknown place: {field!r}")
            parts.append(values[field])
    return F.concat(*parts) if parts else F.lit("")
