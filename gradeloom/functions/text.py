"""Text as Columns: tokens, n-grams, phrases, reasoning markup, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases and patterns that define the markers.
BOILERPLATE = ("certainly!", "certainly,", "absolutely!", "of course!", "great question", "as an ai", "as a language model", "i hope this helps", "let me know if you have any other questions", "let me know if there's anything else", "feel free to ask", "happy to help")
HEDGING = ("it depends", "i'm not sure", "i am not sure", "may or may not", "it's worth noting", "it is worth noting", "it's important to note", "it is important to note", "keep in mind that", "generally speaking", "in most cases", "i can't say for certain")
APOLOGY = ("i apologize", "i'm sorry", "i am sorry", "sorry for the", "apologies for")
SYCOPHANCY = ("you're absolutely right", "you are absolutely right", "you're right", "great point", "excellent point", "excellent question", "i completely agree", "what a great", "that's a great idea")
REFUSAL = ("i can't help with", "i cannot help with", "i can't assist", "i cannot assist", "i'm unable to", "i am unable to", "i won't be able to", "i'm not able to", "i am not able to", "i can't do that", "i cannot do that")
STYLE = {"no_boilerplate": BOILERPLATE, "no_hedging": HEDGING, "no_apology": APOLOGY, "no_sycophancy": SYCOPHANCY, "answered": REFUSAL}
STOCK = {
    "boilerplate": (r"\b(certainly|of course|sure thing)\b\s*[!,.]", r"\bhere(?:'s| is) (?:a|the|how|what|your)\b", r"\bi hope this helps\b", r"\blet me know if\b", r"\bfeel free to\b"),
    "self_reference": (r"\bas an ai\b", r"\bas a language model\b", r"\bi(?:'m| am) (?:just )?an? (?:ai|language model|assistant)\b", r"\bi (?:do not|don't) have (?:personal|feelings|opinions)\b"),
    "hedging": (r"\bit depends\b", r"\bit(?:'s| is) important to (?:note|remember|consider)\b", r"\b(?:generally speaking|in general)\b", r"\bkeep in mind\b", r"\bthat said\b", r"\bto some extent\b"),
    "refusal": (r"\bi can(?:'t|not) (?:help|assist|provide|do that|comply)\b", r"\bi(?:'m| am) (?:unable|not able) to\b", r"\bi (?:won't|will not)\b", r"\bagainst my (?:guidelines|programming|principles)\b", r"\bi must (?:decline|refuse)\b"),
    "sycophancy": (r"\byou(?:'re| are) (?:absolutely )?right\b", r"\b(?:great|excellent|fantastic) (?:question|point)\b", r"\b(?:i apologize|my apologies|so sorry)\b", r"\bthank you for (?:your patience|pointing)\b"),
}


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Every run of n tokens in order, joined by a blank; none of shorter texts."""
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<string>"))


def bigrams(tokens: Column) -> Column:
    """Distinct word pairs; a single word stands for itself."""
    return F.when(F.size(tokens) == 1, tokens).otherwise(F.array_distinct(ngrams(tokens, 2)))


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return found


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that the text has, in list order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p))


def style_markers(text: Column) -> dict[str, Column]:
    """1 where none of a family's phrases is there."""
    return {k: F.when(any_phrase(text, p), 0.0).otherwise(1.0) for k, p in STYLE.items()}


def stock_markers(text: Column) -> dict[str, Column]:
    """1 where one of a family's patterns is there."""
    return {k: F.coalesce(F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(False)).cast("int") for k, patterns in STOCK.items()}


def split_reasoning(text: Column) -> tuple[Column, Column, Column]:
    """(what is said, closed reasoning blocks, an unclosed one's tail)."""
    whole = F.coalesce(text, F.lit(""))
    blocks = F.regexp_extract_all(whole, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    rest = F.regexp_replace(whole, r"(?is)<think>.*?</think>", "")
    tail = F.when(F.rlike(rest, F.lit("(?i)<think>")), F.regexp_extract(rest, r"(?is)<think>(.*)$", 1))
    return F.trim(F.regexp_replace(rest, r"(?is)<think>.*$", "")), blocks, tail


def last_number(text: Column) -> Column:
    """The last number of a text as a double; commas and a leading $ are dropped, a trailing % divides by 100."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\$?\d[\d,]*(?:\.\d+)?%?"), F.lit(0))
    last = F.try_element_at(found, F.lit(-1))
    plain = F.regexp_replace(last, r"[$,%]", "").try_cast("double")
    return F.when(F.endswith(last, F.lit("%")), plain / 100).otherwise(plain)


def last_fence(text: Column) -> Column:
    """The last fenced code block, else the whole text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)```[A-Za-z0-9_+-]*\n?(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise(text)


# How a finished reply ends.
ENDING = r"[.!?:)\"'\]}]\s*$"
ANSWER_LINE = r"^(?:#{2,4}\s*)?[-+]?\$?\d[\d,]*(?:\.\d+)?%?$"
SIGN_OFF = r"(?i)^(?:--+|—|best|all the best|(?:kind|best|warm) regards|regards|thanks|thank you|many thanks|cheers|sincerely|warmly|yours(?: truly| sincerely)?|take care|talk soon)\b"
SIGN_OFF_WORDS, NAME_WORDS = 6, 5


def looks_finished(text: Column) -> Column:
    """Whether a reply reached its end: closing punctuation, a closed fence, an answer line, a sign-off or a name after one."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    last, before = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(lines, F.lit(-2)), F.lit(""))
    count = F.size(F.split(last, r"\s+"))
    signed = (count <= SIGN_OFF_WORDS) & F.rlike(last, F.lit(SIGN_OFF))
    named = (F.size(lines) >= 2) & (count <= NAME_WORDS) & F.rlike(last, F.lit(r"^[\p{Lu}—-]")) & (F.endswith(before, F.lit(",")) | F.rlike(before, F.lit(SIGN_OFF)))
    fenced = F.when(F.endswith(body, F.lit("```")), (F.size(F.split(body, "```")) - 1) % 2 == 0)
    return F.when(body == "", False).when(F.rlike(body, F.lit(ENDING)), True).otherwise(F.coalesce(fenced, F.rlike(last, F.lit(ANSWER_LINE)) | signed | named))
