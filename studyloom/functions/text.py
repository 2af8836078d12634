"""Scalar text functions as Spark column expressions.

All stay inside whole-stage code generation; none is a Python UDF.  Case
folding maps the letters whose folded form is longer before lower-casing,
because lower() alone leaves them as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose case-folded form is not their lower case, and that form.
FOLDS = (("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ŉ", "ʼn"), ("ς", "σ"))
#: The categories of a question and the words that tell them, in the order of the tests.
CATEGORY_WORDS = (
    ("PRIORITY ASSESSMENT", ("first", "priority", "immediate", "most important")),
    ("PATIENT EDUCATION & SAFETY", ("teaching", "understanding", "intervention", "instruction")),
)
OTHER_CATEGORY = "PHYSICAL ASSESSMENT & CUE MAPPING"
CATEGORIES = (*(name for name, _ in CATEGORY_WORDS), OTHER_CATEGORY)
#: What ends a concept in its evidence, in the order of the tests.
CONCEPT_ENDS = ("|", ":", " — ", " - ")
#: Words that a title leaves in lower case.
CONNECTORS = ("and", "of", "for", "with", "in", "on", "to")
#: Fixed value: the white space of Unicode, what (?U)\s matches.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: the fewest characters of a quote that can be evidence.
LEAST_QUOTE = 12
#: File suffixes that can be read.
SUFFIXES = (".pdf", ".docx", ".pptx", ".png", ".jpg", ".jpeg", ".webp", ".txt", ".md")


def trimmed(c: Column) -> Column:
    """Without white space at either end, of any Unicode kind; no pattern, as that would try every character between."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # single spaces, most of all white space, are no matches and so not copied one by one
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:\s+|(?<! ))", " "))


def casefold(c: Column) -> Column:
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.lower(c)


def stem_key(c: Column) -> Column:
    """What two question stems must share to be the same: folded, only a-z and 0-9, single spaces."""
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9]+", " "))


def two_words(c: Column) -> Column:
    """Whether there are two words, white space collapsed or not."""
    return c.rlike(r"(?U)\w\W+\w")


def quotable(quote: Column) -> Column:
    """A quote can be evidence if it has 12 characters, white space collapsed, and two words."""
    return (F.length(collapsed(quote)) >= LEAST_QUOTE) & two_words(quote)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z-]*"), F.lit(0))


def lemma(c: Column) -> Column:
    """A word's cautious singular or stem; the first rule whose suffix and length fit decides."""
    w, n = F.lower(c), F.length(c)

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substring(w, F.lit(1), n - k), F.lit(add))

    return (
        F.when((n > 5) & F.endswith(w, F.lit("ies")), cut(3, "y"))
        .when((n > 5) & w.rlike("(ch|sh|x|z)es$"), cut(2))
        .when((n > 5) & F.endswith(w, F.lit("s")) & ~w.rlike("(s|u|i)s$"), cut(1))
        .when((n > 6) & F.endswith(w, F.lit("ied")), cut(3, "y"))
        .when((n > 6) & F.endswith(w, F.lit("ed")), cut(2))
        .when((n > 7) & F.endswith(w, F.lit("ing")), cut(3))
        .otherwise(w)
    )


def sentence_spans(c: Column) -> Column:
    """Sentences, headings and lines, trimmed, without blanks."""
    parts = F.split(c, r"(?<=[.!?:])\s+|\n+")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def labels(c: Column) -> Column:
    """The "Label:" headings in a line, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?<!\w)([A-Z][A-Za-z0-9 /&()'-]{2,55}:)\s*"), F.lit(1))


def label_parts(c: Column) -> Column:
    """What stands before, between and after the labels."""
    return F.split(c, r"(?<!\w)[A-Z][A-Za-z0-9 /&()'-]{2,55}:\s*", -1)


def heading_level(line: Column) -> Column:
    """The level of a "[Heading n]" line, 1 where n is left out, null for other lines."""
    n = F.regexp_extract(line, r"(?i)^\[Heading(?:\s+(\d+))?\]", 1)
    return F.when(line.rlike(r"(?i)^\[Heading(?:\s+\d+)?\]"), F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1)))


def heading_text(line: Column) -> Column:
    return F.when(heading_level(line).isNotNull(), trimmed(F.regexp_replace(line, r"(?i)^\[Heading(?:\s+\d+)?\]\s*", "")))


def plain_heading(line: Column) -> Column:
    """Whether a line can be a heading: 100 characters at most and no sentence end."""
    return (F.length(line) <= 100) & ~line.rlike(r"[.!?]$")


def bullet_text(c: Column) -> Column:
    """A bullet's text: two characters go after a bullet sign, even where the second is no space."""
    return F.when(c.rlike(r"^[-*•]"), trimmed(F.substring(c, F.lit(3), F.length(c)))).otherwise(c)


def concept(c: Column) -> Column:
    """A concept from evidence: what stands before the first separator that has anything before it, else twelve words."""
    t = trimmed(c)
    tries = [F.when(F.contains(t, F.lit(s)), blank_to_null(F.substring_index(t, s, 1))) for s in CONCEPT_ENDS]
    words = F.array_join(F.slice(F.split(collapsed(t), " "), 1, 12), " ")
    return F.left(F.coalesce(*tries, F.nullif(words, F.lit("")), F.lit("Lecture concept")), F.lit(120))


def stem_key_of(text: str) -> str:
    """stem_key of a Python string."""
    return re.sub("[^a-z0-9]+", " ", text.casefold()).strip()


def concept_of(text: str) -> str:
    """concept of a Python string."""
    whole = text.strip()
    heads = (whole.partition(s)[0].strip() for s in CONCEPT_ENDS if s in whole)
    return (next(filter(None, heads), "") or " ".join(whole.split()[:12]) or "Lecture concept")[:120]


def category(c: Column) -> Column:
    text, out = casefold(c), None
    for name, words in CATEGORY_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_CATEGORY)


def safe_name(c: Column, default: str = "document") -> Column:
    """A name for an object store: other signs become one dash, none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(default))


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def default_title(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"\.[^.]+$", ""), F.lit(70))


def term_title(words: Column) -> Column:
    """Words of a term with capitals, connectors after the first word in lower case."""
    def one(w: Column, i: Column) -> Column:
        return F.when(w.isin(*CONNECTORS) & (i > 0), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))

    return F.array_join(F.transform(words, one), " ")


def without_table_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\[Table row\]\s*", "")


def without_line_signs(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*[-*#]+\s*", "")


def answer_text(c: Column) -> Column:
    """A provider's answer without "correct answer:", "option" and the like before it."""
    return F.regexp_replace(F.trim(casefold(c)), r"^(?:correct\s+)?(?:answer|option|choice)\s*[:#-]?\s*", "")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def paragraphs(c: Column) -> Column:
    """Lines, trimmed, without blanks, with an empty line between each two."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n+"), trimmed), lambda x: x != ""), "\n\n")


def word_count(c: Column) -> Column:
    """Pieces between runs of white space; a blank end counts as a piece."""
    return F.size(F.split(c, r"\s+", -1))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), trimmed), lambda x: x != "")
