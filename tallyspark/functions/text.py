"""Text expressions.  Lengths and offsets are in code points, budgets in UTF-8 bytes; a null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's white space of all scripts.
SPACE = r"(?U)\s+"


def collapsed(text: Column) -> Column:
    """White space of any kind and length is one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    """Runs of what is no white space: the count that word budgets use."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def term_count(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script: the count that compression ratios use."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))).cast("long")


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and white space; pieces of three characters or more."""
    return F.filter(F.transform(F.split(collapsed(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def phrase(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(F.trim(text)), r"\p{Punct}", ""))


def text_quality(text: Column) -> Column:
    """How much a text looks like prose, 0 to 1: letters and digits, printable characters, words.  Short texts score 0.2 at most."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    n = F.length(t).cast("double")
    alnum, printable = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(t, F.lit(r"[^\p{C}\p{Z}]|\x20"))
    score = 0.45 * alnum / n + 0.25 * printable / n + 0.30 * F.least(F.lit(1.0), term_count(t) / F.lit(25.0))
    return F.when(n == 0, 0.0).when(n < 20, F.least(F.lit(0.2), n / 100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def token_estimate(text: Column) -> Column:
    return F.octet_length(text)


def fits(size: Column, context: int, output: int, margin: int, reserve: int = 0) -> Column:
    """Whether a prompt of so many bytes leaves room for the answer, a margin and what a retry adds."""
    return size + (reserve + output + margin) <= context


def title(text: Column, limit: int = 100) -> Column:
    """A title of at most `limit` characters, cut at a blank and marked by an ellipsis."""
    t = collapsed(text)
    head = F.substring(t, 1, limit - 1)
    cut = F.regexp_replace(head, r"^(.+) [^ ]*$", "$1")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.when(F.substring(head, 2, limit).contains(" "), cut).otherwise(head)), F.lit("…")))


def quoted_start(text: Column, quote: Column, occurrence: int = 0) -> Column:
    """0-based place of the n-th occurrence, overlaps counted; null if there are fewer or the quote is blank."""
    at = F.locate(quote, text) if isinstance(quote, str) else F.call_function("locate", quote, text)
    for _ in range(occurrence):
        at = F.when(at > 0, F.call_function("locate", quote, text, at + 1)).otherwise(0)
    return F.when((at > 0) & (F.trim(quote) != ""), at - 1)


def without_heading(text: Column) -> Column:
    """Markdown without a heading in its first line."""
    return F.regexp_replace(text, r"\A {0,3}#{1,6}[ \t]+\S[^\n]*\n?", "")


def blocks(text: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones left out."""
    trimmed = F.transform(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def markdown_title(text: Column) -> Column:
    """The first block if it is a heading, else ''."""
    first = F.get(blocks(text), F.lit(0))
    return F.when(first.startswith("#"), first).otherwise("")


def markdown_paragraphs(text: Column) -> Column:
    b = blocks(text)
    return F.when(markdown_title(text) != "", F.slice(b, 2, F.greatest(F.lit(0), F.size(b) - 1))).otherwise(b)


def without_fence(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```(?i:markdown|md)?\s*", ""), r"\s*```$", "")
    return F.trim(F.when(t.startswith("```") & t.endswith("```"), inner).otherwise(t))


def without_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def paragraphs(text: Column) -> Column:
    """Parts between lines that are blank."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def pages_text(pages: Column) -> Column:
    """The text of a document's pages (structs with `text`): the non-empty ones, joined by blank lines."""
    return F.array_join(F.filter(F.transform(pages, lambda p: F.trim(p["text"])), lambda t: t != ""), "\n\n")


def containment(phrases: Column, text: Column) -> Column:
    """The part of the phrases that the text contains, both normalised; null without phrases.  The text is normalised once, not for each phrase."""
    found = F.transform(F.array(phrase(text)), lambda body: F.filter(phrases, lambda p: F.contains(body, phrase(p))))
    hit = F.size(F.get(found, F.lit(0)))
    return F.try_divide(hit.cast("double"), F.nullif(F.size(phrases), F.lit(0)).cast("double"))
