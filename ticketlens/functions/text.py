"""Text expressions: normalising, shortening, tokens, prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.parse import BLANK_CHARS, to_text

# Patterns, defaults and wordings that decide results.
URL_PATTERN = "http[^ ]+"
NOT_WORD_PATTERN = "[^a-z0-9]+"
BLANKS_PATTERN = "  +"
TOKEN_PATTERN = r"(?U)\w\w+"
CUT_MARK = "[...]"
DEFAULT_ISSUE = "your request"
DEFAULT_PRIORITY = "medium"
MISSING_WORD = "nan"
REPLY = (
    "Thank you for reaching out about %s. We have logged your ticket "
    "as %s priority and a specialist will follow up shortly."
)
PROMPT = "Write a support agent reply. Priority: %s. Issue: %s. Customer: %s"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_blanks(c: Column | str) -> Column:
    """White space of any kind as plain blanks."""
    return F.translate(_col(c), BLANK_CHARS, " " * len(BLANK_CHARS))


def squeeze(c: Column | str) -> Column:
    """Words with one blank between."""
    return F.trim(F.regexp_replace(plain_blanks(c), BLANKS_PATTERN, " "))


def normalise(c: Column | str) -> Column:
    """Lower-case words of a-z and 0-9 with one blank between; links are dropped first."""
    no_links = F.regexp_replace(plain_blanks(F.lower(_col(c))), URL_PATTERN, " ")
    return F.trim(F.regexp_replace(no_links, NOT_WORD_PATTERN, " "))


def join_texts(*columns: Column | str) -> Column:
    """Texts joined by one blank, null as empty, outer white space removed."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in columns]
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return to_text(F.concat(*spaced))


def shorten(c: Column | str, width: int) -> Column:
    """White space squeezed; longer texts end at a word boundary with a cut mark that fits."""
    flat = squeeze(c)
    # The kept words and a blank before the mark fill at most the width.
    kept = F.regexp_extract(F.substring(flat, 1, width - len(CUT_MARK)), r"^(.*) [^ ]*$", 1)
    cut = F.ltrim(F.concat(kept, F.lit(" " + CUT_MARK)))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def template_reply(issue: Column | str = "issue_type", priority: Column | str = "priority") -> Column:
    """Standard reply; a missing issue or priority gets its default wording."""
    return F.format_string(
        REPLY,
        F.coalesce(_col(issue), F.lit(DEFAULT_ISSUE)),
        F.coalesce(_col(priority), F.lit(DEFAULT_PRIORITY)),
    )


def reply_prompt(
    priority: Column | str = "priority",
    issue: Column | str = "issue_type",
    message: Column | str = "initial_message",
    width: int = 200,
) -> Column:
    """Instruction for a text generator with the shortened customer message."""
    missing = F.lit(MISSING_WORD)
    return F.format_string(
        PROMPT,
        F.coalesce(_col(priority), missing),
        F.coalesce(_col(issue), missing),
        F.coalesce(shorten(message, width), missing),
    )


def word_tokens(c: Column | str) -> Column:
    """Lower-cased words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def word_pairs(tokens: Column) -> Column:
    """Neighbouring words joined by a blank."""
    count = F.size(tokens)
    firsts = F.slice(tokens, F.lit(1), F.greatest(count - 1, F.lit(0)))
    seconds = F.slice(tokens, F.lit(2), F.greatest(count - 1, F.lit(0)))
    return F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b))


def terms(c: Column | str) -> Column:
    """Single words followed by word pairs.

    Words are the only entry of a list, so that a text is matched once and not for each use of its words.
    """
    return F.transform(F.array(word_tokens(c)), lambda tokens: F.concat(tokens, word_pairs(tokens)))[0]
