"""Scalar text functions: clean-up, predicates, templates and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column, contains_any, let, round_exact, strip

_WORD_START = rf"(?<![{V.WORD}])"
_WORD_END = rf"(?![{V.WORD}])"

# (?d): only "\n" ends a line.
_LEAD_IN_PREFIX = rf"(?is)^.*?{V.LEAD_IN}"
_CHATTY_PREFIX = rf"(?id)^.{{0,160}}?{_WORD_START}{V.CHATTY_OPENING_WORDS}{_WORD_END}[^:]{{0,120}}:"
_SUMMARY_RULES = (
    (r"[*_`#>]+", " "),
    (rf"(?md)^[{V.WS}]*[-•][{V.WS}]*", " "),
    (rf"(?i){_WORD_START}I'?m{_WORD_END}", ""),
    (rf"(?i){_WORD_START}Here'?s{_WORD_END}", ""),
    (rf"(?i){_WORD_START}{V.FILLER_WORDS}{_WORD_END}[!,. ]*", ""),
    (rf"[{V.WS}]+", " "),
    (r" *, *,+", ", "),
    (r" +([,.:;])", "$1"),
)


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.regexp_extract_all(as_column(text), F.lit(rf"[^{V.WS}]++"), F.lit(0)))


def normalise_content(content: Column | str) -> Column:
    """Plain text of a message content held as VARIANT.

    A string is taken as it is; a list gives the ``text`` of its objects (empty when absent) and its
    other elements as text (``True``, ``None``); anything else is written as text. A missing content is
    empty. Lists and objects inside a list are written as JSON.
    """

    def part_text(part: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(part), F.lit("OBJECT"))
        return F.coalesce(
            F.when(is_object, F.coalesce(F.try_variant_get(part, "$.text", "string"), F.lit(""))).otherwise(
                literal_text(part)
            ),
            F.lit("None"),
        )

    def literal_text(value: Column) -> Column:
        """Text of a scalar: true and false are written with a capital."""
        is_flag = F.schema_of_variant(value) == "BOOLEAN"
        return F.when(is_flag, F.initcap(value.cast("string"))).otherwise(value.cast("string"))

    content = as_column(content)
    parts = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, part_text), "")
    return F.coalesce(
        F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), joined),
        literal_text(content),
        F.lit(""),
    )


def clean_requirements(text: Column | str) -> Column:
    """Requirement text without its chatty lead-in, markdown and filler words."""

    def after_lead_in(t: Column) -> Column:
        head = F.substring(t, 1, V.LEAD_IN_WINDOW)
        lead = F.length(F.regexp_extract(head, _LEAD_IN_PREFIX, 0))

        def cut(n: Column) -> Column:
            chatty = F.length(F.regexp_extract(t, _CHATTY_PREFIX, 0))
            return F.when(n > 0, F.substring(t, n + 1, F.length(t))).otherwise(
                F.substring(t, chatty + 1, F.length(t))
            )

        return let(lead, cut)

    cleaned = let(as_column(text), after_lead_in)
    for pattern, replacement in _SUMMARY_RULES:
        cleaned = F.regexp_replace(cleaned, F.lit(pattern), F.lit(replacement))
    return F.btrim(cleaned, F.lit(" ,.;:"))


def requirements_from_reply(reply: Column | str) -> Column:
    """Requirement text of an assistant reply that carries the completion marker."""
    return clean_requirements(
        strip(F.replace(as_column(reply), F.lit(V.COMPLETE_MARKER), F.lit("")))
    )


def display_text(text: Column | str) -> Column:
    """Text shown to a reader: without the first marker, stripped; null when nothing is left."""

    def without_first(t: Column) -> Column:
        at = F.instr(t, V.COMPLETE_MARKER)
        rest = F.substring(t, at + len(V.COMPLETE_MARKER), F.length(t))
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), rest)).otherwise(t)

    shown = strip(let(as_column(text), without_first), V.DISPLAY_WHITESPACE_CHARS)
    return F.nullif(shown, F.lit(""))


def has_marker(text: Column | str) -> Column:
    """True when the text contains the completion marker."""
    return F.coalesce(F.contains(as_column(text), F.lit(V.COMPLETE_MARKER)), F.lit(False))


def asks_to_proceed(text: Column | str) -> Column:
    """True when the text tells the assistant to stop asking and go ahead."""
    return let(
        F.lower(F.coalesce(as_column(text), F.lit(""))),
        lambda low: contains_any(low, V.PROCEED_PHRASES),
    )


def looks_like_deliverable(text: Column | str) -> Column:
    """True for a long or many-lined answer that is not a short question."""

    def decide(t: Column) -> Column:
        newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        short_question = F.contains(t, F.lit("?")) & (F.length(t) < V.SHORT_QUESTION_LENGTH)
        big = (newlines >= V.DELIVERABLE_NEWLINES) | (F.length(t) > V.DELIVERABLE_LENGTH)
        return ~short_question & big

    return let(strip(F.coalesce(as_column(text), F.lit(""))), decide)


def chunks(text: Column | str, width: int = V.CHUNK_WIDTH) -> Column:
    """Consecutive slices of ``width`` characters; empty array for empty text.

    One pass over the text; slicing by position would walk from its start for every slice.
    """
    return F.regexp_extract_all(as_column(text), F.lit(rf"(?s).{{1,{width}}}"), F.lit(0))


def fill_template(template: str, **values: Column | str) -> Column:
    """A literal template with ``{name}`` places filled by columns."""
    parts: list[Column] = []
    rest = template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), F.coalesce(as_column(value).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def generation_prompt(summary: Column | str, compressed: Column | str) -> Column:
    """Prompt asking for code from a requirement summary."""
    return fill_template(V.GENERATION_PROMPT, summary=summary, compressed=compressed)


def perform_prompt(summary: Column | str, compressed: Column | str) -> Column:
    """Prompt asking for a task's finished result."""
    return fill_template(V.PERFORM_PROMPT, summary=summary, compressed=compressed)


def decompose_prompt(compressed: Column | str) -> Column:
    """Prompt asking for a plan of subtasks."""
    return fill_template(V.DECOMPOSE_PROMPT, compressed=compressed)


def format_usd(amount: Column | str) -> Column:
    """``$0``, four decimals from a cent upwards, six below."""
    amount = as_column(amount)
    return (
        F.when(amount == 0, F.lit("$0"))
        .when(amount >= 0.01, F.format_string("$%.4f", round_exact(amount, 4, ties_up=True)))
        .when(amount.isNotNull(), F.format_string("$%.6f", round_exact(amount, 6, ties_up=True)))
    )
