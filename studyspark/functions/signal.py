"""Features of one session: event-time lists, tap counts and medication text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions.coerce import NUMERIC_TEXT, numeric

# Substrings of the medication answer, in matching order.
MEDICATION_PHRASES = (
    ("AFTER", ("just after", "after parkinson")),
    ("BEFORE", ("immediately before", "before parkinson")),
    ("NO_MEDS", ("don't take parkinson",)),
)
MEDICATION_DEFAULT = "OTHER"
MEDICATION_CODES = {"NO_MEDS": 0, "BEFORE": 1, "AFTER": 2, "OTHER": 3}
STATE_CODES = {"BEFORE": 1, "AFTER": 2, "OTHER": 3}
COUNT_RANGE = (0, 300)

NUMBER = r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*"
NUMBER_LIST = rf"^{NUMBER}(?:,{NUMBER})*$"


def rate(count: Column, duration: Column) -> Column:
    return F.round(F.try_divide(count, F.nullif(duration, F.lit(0.0))), 4)


def time_list(text: Column) -> Column:
    """Sorted ARRAY<DOUBLE> of a bracketed list; NULL if any token is not a number.

    One match clears a list of plain numbers for a whole-array cast; only other spellings (empty
    cells, infinities) are looked at token by token.
    """
    body = F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", "")
    quick = F.split(body, ",").cast("array<double>")
    tokens = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    good = F.forall(tokens, lambda x: x.rlike(NUMERIC_TEXT))
    slow = F.when(good, F.transform(tokens, lambda x: x.try_cast("double")))
    return F.sort_array(F.when(body.rlike(NUMBER_LIST), quick).otherwise(slow))


def gap_sd(stamps: Column) -> Column:
    """Population sd of the gaps of sorted stamps; NULL below three stamps.

    `stamps` must be a plain column: it is read once per gap.
    """
    n = F.size(stamps)
    mean = (F.get(stamps, n - 1) - F.get(stamps, F.lit(0))) / (n - 1)
    squares = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.pow(F.get(stamps, i) - F.get(stamps, i - 1) - mean, F.lit(2.0)),
    )
    return F.when(n >= 3, F.round(F.sqrt(squares / (n - 1)), 6))


def half_rates(stamps: Column) -> Column:
    """Rate over the later gaps minus rate over the earlier ones; NULL below six stamps.

    The mean of consecutive gaps is the distance of the outer stamps over their number.
    """
    n = F.size(stamps)
    half = F.floor((n - 1) / 2).cast("int")
    first, middle = F.get(stamps, F.lit(0)), F.get(stamps, half)
    last = F.get(stamps, n - 1)
    early = F.try_divide(half.cast("double"), middle - first)
    late = F.try_divide((n - 1 - half).cast("double"), last - middle)
    return F.when(n >= 6, F.round(late - early, 6))


def list_length(text: Column) -> Column:
    """Length of a `[...]` literal with at least two items, else NULL."""
    body = F.trim(text)
    n = F.size(F.from_json(body, "array<string>"))
    return F.when(body.rlike(r"(?s)^\[.*\]$") & (n >= 2), n.cast("bigint"))


def tap_count(col: Column, dtype: T.DataType) -> Column:
    """List length, or a plain count in range; otherwise NULL (a handle to a file)."""
    value = numeric(col, dtype)
    low, high = COUNT_RANGE
    plain = F.when(value.between(low, high), F.floor(value).cast("bigint"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(list_length(col), plain)
    return plain


def tap_frequency(count: Column, duration: Column) -> Column:
    return F.when(duration > 0, count.cast("double") / duration)


def medication_state(text: Column, null_policy: str = "other") -> Column:
    """Label of the first phrase found; missing text is OTHER, or NULL on request."""
    low = F.lower(text)
    state = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, phrases in MEDICATION_PHRASES:
        hit = low.contains(phrases[0])
        for phrase in phrases[1:]:
            hit = hit | low.contains(phrase)
        state = state.when(hit, F.lit(label))
    state = state.otherwise(F.lit(MEDICATION_DEFAULT))
    return F.when(text.isNotNull(), state) if null_policy == "null" else state


def code_of(state: Column, codes: dict[str, int]) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for label, code in codes.items():
        expr = expr.when(state == label, F.lit(code).cast("bigint"))
    return expr


def proxy_diagnosis(state: Column) -> Column:
    return F.when(state == "NO_MEDS", F.lit(0)).when(state.isNotNull(), F.lit(1)).cast("bigint")
