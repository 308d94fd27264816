"""Token-level prompt compression as pure column expressions.

A document stays one row: its tokens, scores and keep flags are arrays built by higher-order
functions, so compression is narrow (no explode, no shuffle, no Python worker).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column, is_blank, let, round_exact, text_array

#: (token, index, total) -> score, all columns.
Scorer = Callable[[Column, Column, Column], Column]

# A bare run of text, or a string from its opening quote to the closing quote (or the end of the
# text). A quote right after a backslash is part of the string. Possessive, so that the matcher
# neither recurses nor backtracks on long strings.
_SEGMENT = r'"[^"\\]*+(?:\\++"?+[^"\\]*+)*+"?+|[^"]++'
_BARE_TOKEN = r"[{}\[\]:,]|[^" + V.WS + r"{}\[\]:,]++"
_INNER_TOKEN = r"[^" + V.WS + r"]++"

# Plain words; not the long s, which folds to "s".
_LOWER_WORD = r"^[\p{Ll}&&[^\x{17f}]]++\z"
_CAPITALISED_WORD = r"^\p{Lu}[\p{Ll}&&[^\x{17f}]]++\z"
_NUMBER = r"^\p{Nd}+(?:\.\p{Nd}+)*+\z"
_IDENTIFIER = r"_|^[a-z]+[A-Z][a-zA-Z]*\z"
_CAPITALISED = r"^\p{IsUppercase}[^\p{IsLowercase}\p{IsTitlecase}]*+[\p{IsLowercase}\p{IsTitlecase}]"
# A technical word, hex colour or file name somewhere inside a token, on word boundaries.
_TECH = (
    rf"(?iu)(?:(?:^|[^{V.WORD}])(?:{'|'.join(re.escape(w) for w in V.TECH_WORDS)}"
    rf"|[a-z0-9_][a-z0-9_\-]*\.(?:{V.TECH_FILE_EXTENSIONS}))"
    rf"|[{V.WORD}](?:#[0-9a-f]{{3,6}}|-[a-z0-9_\-]*\.(?:{V.TECH_FILE_EXTENSIONS})))(?:[^{V.WORD}]|\z)"
)
# Tokens that need the search above: more than one word, or the long s that folds to "s". Any
# other token is technical only if it equals one of the words.
_NOT_ONE_PLAIN_WORD = rf"[^{V.WORD}]|\x{{17f}}"


def _is_closed(segment: Column) -> Column:
    """Whether a segment that starts with a quote ends with the one that closes it."""
    ends = F.endswith(segment, F.lit(V.QUOTE)) & (F.substring(segment, -2, 1) != "\\")
    return (F.length(segment) > 1) & ends


def open_at_end(text: Column) -> Column:
    """Whether a text ends inside a string."""
    last = let(F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0)), lambda s: F.get(s, F.size(s) - 1))
    return F.coalesce(let(last, lambda s: F.startswith(s, F.lit(V.QUOTE)) & ~_is_closed(s)), F.lit(False))


def _segment_tokens(segment: Column) -> Column:
    length, closed = F.length(segment), _is_closed(segment)
    body = F.substring(segment, F.lit(2), length - F.when(closed, 2).otherwise(1))
    quoted = F.concat(
        text_array([V.QUOTE]),
        F.regexp_extract_all(body, F.lit(_INNER_TOKEN), F.lit(0)),
        F.when(closed, text_array([V.QUOTE])).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.startswith(segment, F.lit(V.QUOTE)), quoted).otherwise(
        F.regexp_extract_all(segment, F.lit(_BARE_TOKEN), F.lit(0))
    )


def tokenize(text: Column | str) -> Column:
    """Split text into tokens, JSON-aware; null text gives null."""
    text = as_column(text)
    segments = F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))
    return F.when(
        F.contains(text, F.lit(V.QUOTE)), F.flatten(F.transform(segments, _segment_tokens))
    ).otherwise(F.regexp_extract_all(text, F.lit(_BARE_TOKEN), F.lit(0)))


def is_skeleton(token: Column) -> Column:
    """Structural JSON characters and quotes: always kept, never a key."""
    return token.isin(*V.STRUCTURAL, V.QUOTE)


def _core(token: Column) -> Column:
    """The token without surrounding punctuation and quotes."""
    return F.btrim(token, F.lit(V.PUNCTUATION))


def _is_technical(core: Column) -> Column:
    return F.lower(core).isin(*V.TECH_WORDS) | (
        F.rlike(core, F.lit(_NOT_ONE_PLAIN_WORD)) & F.rlike(core, F.lit(_TECH))
    )


def _by_length(core: Column, score: Column) -> Column:
    for longest, value in V.SCORE_BY_LENGTH:
        score = score.when(F.length(core) <= longest, value)
    return score.otherwise(V.SCORE_LONG_WORD)


def _score(token: Column, core: Column) -> Column:
    mark = (
        F.when(token.isin(*V.STRUCTURAL), V.SCORE_STRUCTURAL)
        .when(token == V.QUOTE, V.SCORE_QUOTE)
        .when(is_blank(token), 0.0)
        .otherwise(V.SCORE_PUNCTUATION_ONLY)
    )
    # Most tokens are plain words; one or two tests spare them the other patterns.
    lower_word = _by_length(
        core,
        F.when(core.isin(*V.STOP_WORDS), V.SCORE_STOP_WORD).when(
            core.isin(*V.TECH_WORDS), V.SCORE_TECH
        ),
    )
    capitalised_word = F.when(
        F.lower(core).isin(*V.TECH_WORDS), V.SCORE_TECH
    ).otherwise(V.SCORE_CAPITALISED)
    other = _by_length(
        core,
        F.when(F.rlike(core, F.lit(_NUMBER)), V.SCORE_NUMBER)
        .when(F.rlike(core, F.lit(_IDENTIFIER)), V.SCORE_IDENTIFIER)
        .when(_is_technical(core), V.SCORE_TECH)
        .when(F.rlike(core, F.lit(_CAPITALISED)), V.SCORE_CAPITALISED)
        .when(F.lower(core).isin(*V.STOP_WORDS), V.SCORE_STOP_WORD),
    )
    return (
        F.when(core == "", mark)
        .when(F.rlike(core, F.lit(_LOWER_WORD)), lower_word)
        .when(F.rlike(core, F.lit(_CAPITALISED_WORD)), capitalised_word)
        .otherwise(other)
    )


def default_score(token: Column) -> Column:
    """Preservation score in [0, 1] of one token; the first matching rule decides."""
    return let(_core(token), lambda core: _score(token, core))


def score_tokens(tokens: Column, scorer: Scorer | None = None) -> Column:
    """Scores of a token array, in token order, before the key boost."""
    if scorer is not None:
        return let(
            tokens,
            lambda ts: F.transform(ts, lambda t, i: scorer(t, i, F.size(ts)).cast("double")),
        )
    return let(
        tokens,
        lambda ts: F.transform(
            F.transform(ts, lambda t: _core(t)), lambda core, i: _score(F.get(ts, i), core)
        ),
    )


def boost_keys(tokens: Column, scores: Column) -> Column:
    """Raise tokens that stand right before a ``:`` (one quote may lie between) to key level."""

    def boosted(score: Column, i: Column) -> Column:
        after, second = F.get(tokens, i + 1), F.get(tokens, i + 2)
        before_colon = (after == ":") | ((after == V.QUOTE) & (second == ":"))
        is_key = F.coalesce(before_colon, F.lit(False)) & ~is_skeleton(F.get(tokens, i))
        return F.when(is_key, F.greatest(score, F.lit(V.SCORE_JSON_KEY))).otherwise(score)

    return F.when(F.array_contains(tokens, ":"), F.transform(scores, boosted)).otherwise(scores)


def keep_threshold(scores: Column, ratio: Column | float) -> Column:
    """The lowest score that survives: the ``max(1, int(n * ratio))``-th highest; null if empty."""
    ratio = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio.cast("double")
    n = F.size(scores)
    rank = F.least(n, F.greatest(F.lit(1), (n * ratio).cast("int")))
    return F.get(F.sort_array(scores, asc=False), rank - 1)


# Tokens hold no whitespace, so once blanks around marks are gone, commas and colons have no blank
# next to them and runs of them are adjacent.
_TIDY = (
    (r" *([{}\[\]:,]) *", "$1"),
    (r'" +', '"'),
    (r' +"', '"'),
    (r",{2,}", ","),
    (r"([:{\[]),+", "$1"),
    (r",+([}\]])", "$1"),
    (r",\z", ""),
    (rf",(?=[A-Za-z][{V.WORD}.\-]*+:)", " "),
    (r"(^|[ ,{\[]) *:+ *", "$1"),
    (r": *(?=[:,])", ""),
    (r" {2,}", " "),
)
_MARKS = r'["{}\[\]:]'
# All that the rules above do to text without such marks (outer commas are stripped anyway).
_TIDY_PROSE = ((r" *,[ ,]*", ","),)


def _replace_all(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def tidy_joined(joined: Column) -> Column:
    """Tidy the spacing, comma and colon leftovers of dropped words in kept tokens joined by blanks."""

    def tidy(text: Column) -> Column:
        return F.when(F.rlike(text, F.lit(_MARKS)), _replace_all(text, _TIDY)).otherwise(
            _replace_all(text, _TIDY_PROSE)
        )

    return F.btrim(let(joined, tidy), F.lit(" :,"))


def reconstruct(kept: Column) -> Column:
    """Join kept tokens and tidy the spacing, comma and colon leftovers of dropped words."""
    return tidy_joined(F.array_join(kept, " "))


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Share of tokens dropped, 4 digits."""
    return F.when(original > 0, round_exact(1 - compressed / original, 4)).otherwise(F.lit(0.0))


def compression_multiplier(original: Column, compressed: Column) -> Column:
    """How many times smaller the prompt became, 2 digits."""
    return F.when(compressed > 0, round_exact(original / compressed, 2)).otherwise(F.lit(1.0))


def _tagged(tokens: Column, base: Column, ratio: Column | float) -> Column:
    return let(
        boost_keys(tokens, base),
        lambda scores: F.struct(
            tokens.alias("tokens"),
            scores.alias("scores"),
            keep_threshold(scores, ratio).alias("threshold"),
        ),
    )


def tagged_tokens(
    text: Column | str, ratio: Column | float = V.DEFAULT_PRESERVE_RATIO, scorer: Scorer | None = None
) -> Column:
    """``struct<tokens, scores, threshold>`` of a text; arrays are empty for token-free text.

    Every array is bound once (see :func:`let`).
    """
    return let(
        F.coalesce(tokenize(text), F.array().cast("array<string>")),
        lambda tokens: let(
            score_tokens(tokens, scorer), lambda base: _tagged(tokens, base, ratio)
        ),
    )


#: Groups of result fields; a struct holds those asked for, and the work for others is not done.
TEXT_AND_STATS, ALL_FIELDS = ("text", "stats"), ("text", "stats", "tokens")


def _finished(tagged: Column, text: Column, exact_scores: bool, wanted: Sequence[str]) -> Column:
    tokens, scores, threshold = tagged["tokens"], tagged["scores"], tagged["threshold"]

    def shown(score: Column) -> Column:
        # Default scores have two digits already.
        return score if exact_scores else round_exact(score, 2)

    def survives(token: Column, i: Column) -> Column:
        return (F.get(scores, i) >= threshold) | is_skeleton(token)

    def flagged(t: Column, i: Column) -> Column:
        return F.struct(t.alias("text"), survives(t, i).alias("kept"), shown(F.get(scores, i)).alias("score"))

    def texts(flags: Column) -> Column:
        return F.transform(F.filter(flags, lambda t: t["kept"]), lambda t: t["text"])

    def fields(kept: Column, flags: Column | None) -> Column:
        original, left = F.size(tokens), F.size(kept)
        columns = []
        if "text" in wanted:
            columns.append(F.when(original > 0, reconstruct(kept)).otherwise(text).alias("compressed"))
        if "stats" in wanted:
            columns += [
                original.alias("original_tokens"),
                left.alias("compressed_tokens"),
                compression_ratio(original, left).alias("ratio"),
                compression_multiplier(original, left).alias("multiplier"),
            ]
        if flags is not None:
            columns.append(flags.alias("tokens"))
        return F.struct(*columns)

    if "tokens" not in wanted:
        return let(F.filter(tokens, survives), lambda kept: fields(kept, None))
    # which tokens are kept is decided once; the kept texts are taken from the flags
    all_flags = F.transform(tokens, flagged)
    if len(wanted) == 1:
        return F.struct(all_flags.alias("tokens"))
    return let(all_flags, lambda flags: let(texts(flags), lambda kept: fields(kept, flags)))


def compress_struct(
    text: Column | str,
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    scorer: Scorer | None = None,
    detailed: bool = False,
    wanted: Sequence[str] | None = None,
) -> Column:
    """Compress one text column.

    Gives ``struct<compressed, original_tokens, compressed_tokens, ratio, multiplier>`` and, when
    ``detailed``, ``tokens array<struct<text, kept, score>>`` in token order. Text without tokens
    comes back unchanged with stats (0, 0, 0.0, 1.0). ``wanted`` names the groups of fields instead,
    out of ``ALL_FIELDS``: the text, the statistics, the tokens.
    """
    groups = wanted or (ALL_FIELDS if detailed else TEXT_AND_STATS)
    return let(
        tagged_tokens(text, ratio, scorer),
        lambda tagged: _finished(tagged, as_column(text), scorer is None, groups),
    )


def compress_scored_struct(
    text: Column | str,
    tokens: Column | str,
    scores: Column | str,
    ratio: Column | float = V.DEFAULT_PRESERVE_RATIO,
    detailed: bool = False,
) -> Column:
    """Like :func:`compress_struct` for token and score arrays that are columns already."""
    return let(
        F.struct(as_column(tokens).alias("k"), as_column(scores).cast("array<double>").alias("s")),
        lambda given: let(
            _tagged(given["k"], given["s"], ratio),
            lambda tagged: _finished(tagged, as_column(text), False, ALL_FIELDS if detailed else TEXT_AND_STATS),
        ),
    )
