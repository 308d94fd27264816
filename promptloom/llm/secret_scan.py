"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control.

Everything is a column expression: a text stays one row, its matches are arrays, and nothing runs
in Python. Besides the patterns, every run of at least ``SHORTEST`` letters, digits and ``+/_-=`` that
mixes letters with digits is a candidate. Signs separate its parts or belong to base 64, whose other
symbols are uniform without them, so the parts are tested joined; the longest part is tested alone too if it
could be a candidate, as a key may follow a plain prefix. The alphabet is inferred (hex,
base 32, lower case, base 58, alphanumeric) and these statistics of the symbols are taken:

* chi-squared against a uniform alphabet, which counts how many pairs of symbols are equal;
* runs: how often letters and digits alternate, or a small letter is followed by a capital, inside a part;
* for hex, how many letters are all of its six;
* serial correlation of neighbouring symbols' positions in the alphabet.

The hypothesis to reject is that the candidate is ordinary text of its length, whose symbols are as
uneven as letters of names and prose, whose letters and digits keep together, and which is then no secret.
The first three give a probability each under it (the runs one by the exact tail of the Poisson law), which falls with
the length, and are combined by Fisher's rule. Candidates that could not be random either (symbols far too uneven or
serially bound) are never reported. The Benjamini-Hochberg rule, applied to the candidates of the
whole table within each class of lengths, bounds the share of ordinary text among what is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import free_names, let, running_total

#: Kinds in their order, with the pattern and the condition that a match has to meet.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A candidate: letters, digits and signs of base 64, with at least this many characters.
SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")

#: Share of reported candidates that may be ordinary text.
FALSE_DISCOVERIES = 0.01
#: Ordinary text: chance that two symbols are equal, changes by neighbouring pair, and chance that a letter is one of hex.
TEXT_COLLISION, TEXT_CHANGES, TEXT_IN_HEX = 0.055, 0.08, 0.315
#: A change: between letter and digit, or from a small letter to a capital.
CHANGE = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"
#: Beyond this mean the Poisson law is as good as normal, and no probability is taken for smaller than this.
LARGE_MEAN, SMALLEST = 300.0, 1e-12
#: Randomness is given up beyond so many standard deviations.
GIVE_UP = 3.5
#: Lower ends of the classes of lengths, and how finely probabilities are counted (by their logarithm).
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
STEPS = 40

_ALPHABETS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    (r"", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
SPANS = "array<struct<start:bigint,end:bigint,kind:int,text:string,value:string>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, kind, text, value)``, in code points.

    What lies between the matches is what splitting by the pattern gives, so that lengths add up to
    positions; ``value`` is the given group of the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def located(all_found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(all_found)), lambda g: F.length(g).cast("bigint"))
        steps = F.zip_with(gaps, all_found, lambda g, m: g + F.length(m))
        parts = F.arrays_zip(all_found.alias("m"), values.alias("v"), gaps.alias("g"), running_total(steps).alias("s"))
        return F.transform(
            parts,
            lambda p: F.struct(
                (p["s"] + p["g"]).alias("start"),
                (p["s"] + p["g"] + F.length(p["m"])).alias("end"),
                F.lit(kind).alias("kind"),
                p["m"].alias("text"),
                p["v"].alias("value"),
            ),
        )

    return let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(SPANS)))


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns, in their order."""
    assign = F.filter(matches(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6)
    return F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans that no base span touches and that have both letters and digits."""
    found = matches(text, CANDIDATE, 3)
    mixed = F.filter(found, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    return let(
        base,
        lambda known: F.filter(
            mixed, lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ),
    )


# --- the battery ----------------------------------------------------------------------------------


def _normal_below(z: Column) -> Column:
    """Distribution function of the normal law, by its logistic approximation."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.07056)))


def poisson_from(k: Column, mean: Column) -> Column:
    """Chance of at least ``k`` events where ``mean`` are expected."""

    def exact(x: Column) -> Column:
        start = F.struct(F.exp(-x["mean"]).alias("term"), F.lit(0.0).alias("below"))
        below = F.aggregate(
            F.sequence(F.lit(1), x["k"]),
            start,
            lambda acc, i: F.struct((acc["term"] * x["mean"] / i).alias("term"), (acc["below"] + acc["term"]).alias("below")),
            lambda acc: acc["below"],
        )
        far = F.lit(1.0) - _normal_below((x["k"] - F.lit(0.5) - x["mean"]) / F.sqrt(x["mean"]))
        return F.when(x["k"] <= 0, F.lit(1.0)).when(x["mean"] > LARGE_MEAN, far).otherwise(F.lit(1.0) - below)

    return let(F.struct(k.cast("int").alias("k"), mean.cast("double").alias("mean")), exact)


def _alphabet(plain: Column) -> Column:
    return reduce(lambda rest, a: F.when(plain.rlike(a[0]), F.lit(a[1])).otherwise(rest), reversed(_ALPHABETS[:-1]), F.lit(_ALPHABETS[-1][1]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def battery(plain: Column, changes: Column, pairs_inside: Column) -> Column:
    """Logarithm of the chance that ordinary text looks as random as the letters and digits ``plain``; null for what cannot be random.

    ``changes`` counts the :data:`CHANGE` places among ``pairs_inside`` neighbouring symbols.
    """

    def tests(x: Column) -> Column:
        symbols, k = x["symbols"], F.length(x["alphabet"]).cast("double")
        n = F.size(symbols).cast("double")
        pairs = n * (n - 1) / 2
        equal = _total(
            F.transform(
                F.transform(F.array_distinct(symbols), lambda a: F.size(F.filter(symbols, lambda y: y == a)).cast("double")),
                lambda c: c * (c - 1) / 2,
            )
        )

        def judged(m: Column) -> Column:
            mean, first, second = m["mean"], F.slice(symbols, 1, F.size(symbols) - 1), F.slice(symbols, 2, F.size(symbols) - 1)
            too_uneven = (m["equal"] - pairs / k) / F.sqrt(pairs / k * (1 - 1 / k))
            spread = _total(F.transform(symbols, lambda y: (y - mean) * (y - mean)))
            joint = _total(F.zip_with(first, second, lambda a, b: (a - mean) * (b - mean)))
            serial = F.when(spread > 0, joint / spread * F.sqrt(n)).otherwise(F.lit(99.0))
            # pairs of equal symbols are chi-squared up to a linear map
            evenness = (m["equal"] - pairs * TEXT_COLLISION) / (F.sqrt(pairs * TEXT_COLLISION * (1 - TEXT_COLLISION)) * 1.2)
            chances = [
                _normal_below(evenness),
                poisson_from(changes, F.greatest(pairs_inside * TEXT_CHANGES, F.lit(1e-9))),
                F.when(k == 16, F.pow(F.lit(TEXT_IN_HEX), F.regexp_count(plain, F.lit("[A-Za-z]")))).otherwise(F.lit(1.0)),
            ]
            fisher = -reduce(lambda a, b: a + b, [F.log(F.greatest(c, F.lit(SMALLEST))) for c in chances])
            # survival of chi-squared with six degrees of freedom at twice this sum
            survival = let(fisher, lambda f: F.log(F.lit(1.0) + f + f * f / 2) - f)
            return F.when((too_uneven < GIVE_UP) & (F.abs(serial) < GIVE_UP), survival)

        # bound once: within the lambdas they would be counted anew for every symbol
        return let(F.struct(equal.alias("equal"), (_total(symbols) / n).alias("mean")), judged)

    def placed(alphabet: Column) -> Column:
        found = F.filter(F.split(plain, ""), lambda c: c != "")
        return F.struct(F.transform(found, lambda c: F.instr(alphabet, c).cast("double")).alias("symbols"), alphabet.alias("alphabet"))

    return let(let(_alphabet(plain), placed), tests)


def log_probability(candidate: Column) -> Column:
    """Logarithm of the chance that ordinary text looks as random; null for what cannot be random.

    The better of two tests where the longest part is tested beside the whole, at twice its chance.
    """

    def tested_parts(p: Column) -> Column:
        whole = battery(p["whole"], F.regexp_count(candidate, F.lit(CHANGE)), F.length(p["whole"]) - p["parts"])
        longest = battery(p["longest"], F.regexp_count(p["longest"], F.lit(CHANGE)), F.length(p["longest"]) - 1)
        two = (p["parts"] > 1) & (F.length(p["longest"]) >= SHORTEST)
        return F.when(two, F.least(whole, longest) + F.log(F.lit(2.0))).otherwise(whole)

    parts = F.filter(F.split(candidate, "[^A-Za-z0-9]+"), lambda x: x != "")
    longest = lambda ps: F.array_max(F.transform(ps, lambda x: F.struct(F.length(x).alias("n"), x.alias("part"))))["part"]
    split = let(parts, lambda ps: F.struct(F.array_join(ps, "").alias("whole"), longest(ps).alias("longest"), F.size(ps).alias("parts")))
    return let(split, tested_parts)


def length_class(length: Column) -> Column:
    return reduce(lambda rest, b: F.when(length >= b, F.lit(b)).otherwise(rest), LENGTHS[1:], F.lit(LENGTHS[0]))


def tested(text: Column) -> Column:
    """Base spans and candidates with ``(length class, step)`` of their probability (null: given up)."""
    return let(
        base_spans(text),
        lambda base: F.struct(
            base.alias("base"),
            F.transform(
                candidates(text, base),
                lambda s: F.struct(
                    s.alias("span"),
                    length_class(F.length(s["text"])).alias("length"),
                    F.floor(log_probability(s["text"]) * STEPS).cast("int").alias("step"),
                ),
            ).alias("more"),
        ),
    )


def discovery_steps(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each class of lengths the largest step that is reported.

    ``found`` has the candidates of the whole table as arrays in ``more``. They are counted by class
    and step before anything moves, so the driver gets at most a thousand counts a class. Within a
    class the rule takes the largest probability p of which at least ``p * m / rate`` candidates have
    none larger, m being the number of candidates; each step counts with its upper end.
    """
    rows = (
        found.select(F.explode("more").alias("c"))
        .groupBy("c.length", "c.step")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    by_class: dict[int, dict[int | None, int]] = {}
    for length, step, n in rows:
        by_class.setdefault(length, {})[step] = n
    steps: dict[int, int] = {}
    for length, counts in by_class.items():
        m, so_far = sum(counts.values()), 0
        for step in sorted(s for s in counts if s is not None):
            so_far += counts[step]
            if m * 2.718281828459045 ** ((step + 1) / STEPS) <= rate * so_far:
                steps[length] = step
    return steps


def scan(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERIES, found_col: str = "_found") -> DataFrame:
    """``docs`` with ``found_col``: spans as an array of ``(start, end, kind, text)``, by start, then kind.

    A column of that name is replaced.

    Two scans of the texts: one counts the candidates' probabilities, one reports. Null and empty
    texts have no spans. Overlapping matches of different kinds are all reported; candidates of the
    battery only where no fixed pattern matches. Repeated rows are scanned each; an empty table gives
    an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    steps = discovery_steps(docs.select(tested(text)["more"].alias("more")), rate)
    limit = reduce(
        lambda rest, s: (lambda c: F.when(c["length"] == s[0], c["step"] <= s[1]).otherwise(rest(c))),
        steps.items(),
        lambda c: F.lit(False),
    )
    result = tested(text)
    spans = let(
        result,
        lambda r: F.array_sort(
            F.transform(
                F.concat(
                    r["base"],
                    F.transform(F.filter(r["more"], lambda c: F.coalesce(limit(c), F.lit(False))), lambda c: c["span"]),
                ),
                lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")),
            )
        ),
    )
    return docs.withColumn(found_col, spans)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)`` for every row.

    Other columns are not read. An empty table gives an empty one.
    """
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def of(kind: int) -> Column:
        return F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_listed(F.filter("_found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("_found")).alias("spans"),
        of(3).alias("n_random"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; overlapping spans become one mark.

    All other columns, whatever their names, and all rows stay; null stays null. An empty table gives an empty one.
    """
    (spans,) = free_names(docs, "_found")
    found = scan(docs, text_col, found_col=spans)
    text = F.col(text_col).cast("string")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    # spans come by start: one that begins before the last one's end only moves that end
    cut = F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) , F.array_append(
                acc["parts"],
                F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)),
            )).otherwise(acc["parts"]).alias("parts"),
        ),
    )
    clean = let(
        cut, lambda c: F.concat(F.array_join(c["parts"], ""), F.substring(text, (c["at"] + 1).cast("int"), F.length(text)))
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)
