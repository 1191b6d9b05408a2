"""String, path and pattern expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
# They are read by Java (with U: \w, \b and \d as in Unicode) and by Python alike.
REFERENCE_HEADING = r"\b(references|bibliography|works\s+cited|acknowledg|tài\s+liệu\s+tham\s+khảo)"
CITATION = r"(?:\(?\b(?:19|20)\d{2}\b\)?|\bet\s+al\b|https?://|\bdoi\b|\bpp\.\s*\d|\bvol\.\s*\d)"
TABLE_REFERENCE = r"(?<![\w-])(?:table|bảng|bang)\s*([A-Za-z]?\.?\d+(?:\.\d+)*[a-z]?)(?!\w)"
SECTION_WORD = r"(?<![\w-])(?:section|sections|subsection|chapter|mục|phần|chương)(?![\w-])"
NAMED_SECTION = r"\b(?:section|sections|subsection|chapter|mục|phần|chương)\s+([A-Za-z]?\d+(?:\.\d+)*)"
DOTTED_NUMBER = r"(?<![A-Za-z0-9_-])([A-Za-z]?\d+(?:\.\d+)+)(?![A-Za-z0-9])"
BARE_NUMBER = r"(?<![A-Za-z0-9_.-])(\d+)(?![A-Za-z0-9_])"
CAPTION = r"^\s*\**\s*(table|bảng|figure|hình)\s*([A-Za-z]?\.?\d+(?:\.\d+)*[a-z]?)\s*[:.\-]"
SECTION_NUMBER = r"^((?:\d+|[A-Za-z])(?:\.\d+)*)\.?\s+(.*)$"
PAGE_MARKER = r"(?i)^\s*(?:page\s*\d+|\d+|\(\d+\s+of\s+\d+\)|continued)?\s*$"
TERM = r"[\p{L}\p{N}]+"

_JAVA = "(?iuU)"
REFERENCE_MIN_CHARS, REFERENCE_WINDOW, REFERENCE_PER_WINDOW = 200, 500, 2.0


def or_default(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def normalised(column: Column) -> Column:
    """Lower case with every run of other than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^a-z0-9]+", " "))


def terms(column: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats included."""
    return F.regexp_extract_all(F.lower(column), F.lit(f"({TERM})"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a name that only starts with a dot has none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def clean_heading(column: Column) -> Column:
    """Marks of emphasis and white space as single spaces."""
    return F.trim(F.regexp_replace(column, r"[\s*]+", " "))


def section_number(title: Column) -> Column:
    """Leading number ("2.1", "A.3"), empty if the heading has none."""
    return F.regexp_extract(title, SECTION_NUMBER, 1)


def section_title(title: Column) -> Column:
    return F.when(section_number(title) == "", title).otherwise(F.regexp_extract(title, SECTION_NUMBER, 2))


def reference_like(heading: Column, text: Column) -> Column:
    """A list of references by a word in its heading, or by two marks of citation or more to 500 characters of a longer text."""
    citations = F.regexp_count(text, F.lit(_JAVA + CITATION))
    dense = (F.length(text) >= REFERENCE_MIN_CHARS) & (citations / (F.length(text) / REFERENCE_WINDOW) >= REFERENCE_PER_WINDOW)
    return F.coalesce(heading.rlike(_JAVA + REFERENCE_HEADING), F.lit(False)) | F.coalesce(dense, F.lit(False))


def number_variants(number: Column) -> Column:
    """The number as it stands, in upper and in lower case, without a last full stop; distinct, in that order."""
    plain = F.regexp_replace(F.trim(number), r"\.+$", "")
    return F.array_distinct(F.array(plain, F.upper(plain), F.lower(plain)))


def table_references(text: Column) -> Column:
    """Numbers of the tables a text names, with their case variants, in order and distinct."""
    found = F.regexp_extract_all(text, F.lit(_JAVA + TABLE_REFERENCE), 1)
    return F.array_distinct(F.flatten(F.transform(found, number_variants)))


def section_references(text: Column) -> Column:
    """Section numbers a text names, in order and distinct: after a keyword, dotted, or bare; not the number in a name like GPT-4."""
    any_of = "|".join((NAMED_SECTION, DOTTED_NUMBER, BARE_NUMBER))
    whole = F.regexp_extract_all(text, F.lit(_JAVA + any_of), 0)
    return F.array_distinct(F.transform(whole, lambda m: F.regexp_extract(m, r"([A-Za-z]?\d+(?:\.\d+)*)$", 1)))


def section_cue(text: Column) -> Column:
    """Whether a text speaks of sections by a word or by a dotted number."""
    return text.rlike(_JAVA + SECTION_WORD) | text.rlike(_JAVA + DOTTED_NUMBER)


def bare_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_JAVA + BARE_NUMBER), 1))


def mentions_document(query: Column, path: Column) -> Column:
    """Whether the normalised query contains the normalised stem or file name."""
    within = lambda name: (normalised(name) != "") & F.contains(normalised(query), normalised(name))
    return F.coalesce(within(stem(path)) | within(file_name(path)), F.lit(False))


def json_object(text: Column) -> Column:
    """From the first { to the last }; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def context_block(rank: Column, title: Column, url: Column, section: Column, crumbs: Column, score: Column, text: Column) -> Column:
    """One numbered source as it stands in a prompt; crumbs: titles of the sections around, outermost first."""
    return F.format_string(
        # Fixed value: the format of a source.
        "[Source %d]\nTitle: %s\nURL: %s\nSection: %s\nBreadcrumbs: %s\nScore: %.4f\nText: %s",
        rank,
        F.coalesce(title, F.lit("No Title")),
        F.coalesce(url, F.lit("No URL")),
        F.coalesce(section, F.lit("")),
        F.coalesce(F.array_join(crumbs, " > "), F.lit("")),
        F.coalesce(score, F.lit(0.0)),
        F.coalesce(text, F.lit("")),
    )


def history_line(role: Column, text: Column) -> Column:
    """Every role but user speaks as the assistant."""
    return F.concat(F.when(role == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), text)
