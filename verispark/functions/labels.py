"""Label rules: domains, cleaning of damaged labels, classes of damage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verispark.functions.text import strip

# Label domains.
UAM_LABELS = ("0", "1", "2", "3")
VERBAL_LABELS = ("PRAWDA", "CZĘŚCIOWA_PRAWDA", "FAŁSZ", "MANIPULACJA", "NIEWERYFIKOWALNE")
VERBAL_EXTENDED = (*VERBAL_LABELS, "4")
ERROR = "ERROR"
ERROR_MAX_STEPS = "ERROR_MAX_STEPS"
UNFIXABLE = (ERROR, "None", "N/A", "-1", "")
LABEL_CLASSES = (
    "valid",
    "error_max_steps",
    "error_generic",
    "fixable_float",
    "fixable_prefix",
    "fixable_array",
    "corrupt_float_oob",
    "corrupt_other",
)
FIXABLE_CLASSES = ("fixable_float", "fixable_prefix", "fixable_array")

# Text that is a plain number; try_cast alone would also take "1d" and "NaN".
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
LONE_DIGIT = r"(?<![\p{L}\p{N}_])([0-3])(?![\p{L}\p{N}_])"


def is_verbal_agent(agent: Column) -> Column:
    return F.lower(agent).contains("dem")


def valid_for_agent(label: Column, agent: Column) -> Column:
    """Verbal agents also take the digits; the others take digits only."""
    return label.isin(*UAM_LABELS) | (is_verbal_agent(agent) & label.isin(*VERBAL_EXTENDED))


def as_number(label: Column) -> Column:
    return F.when(label.rlike(NUMBER), label.try_cast("double"))


def _first(found: Column) -> Column:
    return F.when(found != "", found)


def fix_float(label: Column) -> Column:
    """'1.0' gives '1'; '2.5' and numbers outside 0-3 give NULL."""
    x = as_number(label)
    whole = F.bround(x, 0)
    return F.when((F.abs(x - whole) < 0.01) & whole.between(0, 3), whole.cast("int").cast("string"))


def fix_prefix(label: Column) -> Column:
    """First digit 0-3 that stands alone."""
    return _first(F.regexp_extract(label, LONE_DIGIT, 1))


def fix_array(label: Column) -> Column:
    """First item of a list text, when it is a digit 0-3."""
    items = F.from_json(F.replace(label, F.lit("'"), F.lit('"')), "array<string>")
    head = strip(F.get(items, F.lit(0)))
    return F.when(head.isin(*UAM_LABELS), head)


def fix_label(label: Column, agent: Column, strict: bool = False) -> Column:
    """Repaired label, or NULL. `strict` refuses halves ('2.5') and negative numbers ('-1')."""
    fixed = F.coalesce(fix_float(label), fix_prefix(label), fix_array(label))
    if strict:
        x = as_number(label)
        fixed = F.when(x.isNull() | fix_float(label).isNotNull(), fixed)
    return F.when(valid_for_agent(fixed, agent), fixed)


def is_standard(label: Column) -> Column:
    return label.isin(*UAM_LABELS, *VERBAL_EXTENDED)


def classify_label(label: Column, agent: Column) -> Column:
    """One of `LABEL_CLASSES`; the order of the tests matters."""
    x = as_number(label)
    in_range = F.bround(x, 0).between(0, 3)
    return (
        F.when(valid_for_agent(label, agent), "valid")
        .when(label == ERROR_MAX_STEPS, "error_max_steps")
        .when(label == ERROR, "error_generic")
        .when(x.isNotNull() & in_range, "fixable_float")
        .when(x.isNotNull(), "corrupt_float_oob")
        .when(label.rlike(LONE_DIGIT), "fixable_prefix")
        .when(label.startswith("["), "fixable_array")
        .otherwise("corrupt_other")
    )


def normalize_uam_label(raw: Column) -> Column:
    """Near-whole number to a digit, else the first lone digit 0-3, else the stripped text."""
    s = strip(raw)
    return F.coalesce(fix_float(s), fix_prefix(s), s)


def label_first_digit(answer: Column) -> Column:
    """First digit 0-3 anywhere in the text, else the stripped text."""
    s = strip(answer)
    return F.coalesce(_first(F.regexp_extract(s, "[0-3]", 0)), s)


def label_cot(answer: Column) -> Column:
    """A lone digit; else the one after `Odpowiedź:`; else the last digit 0-3; else the text."""
    s = strip(answer)
    named = _first(F.regexp_extract(s, r"[Oo]dpowied[źz]:\s*([0-3])", 1))
    last = _first(F.regexp_extract(s, r"(?s)^.*([0-3])", 1))
    return F.when(s.isin(*UAM_LABELS), s).otherwise(F.coalesce(named, last, s))


def label_verbal(answer: Column, mode: str = "compat") -> Column:
    """Verbal label named after `Odpowiedź:`, else one contained in the text, else ERROR.

    `compat` takes the first of the list, so the longer label that contains PRAWDA is read as
    PRAWDA; `longest` tries longer labels first.
    """
    if mode not in ("compat", "longest"):
        raise ValueError(f"unknown mode {mode!r}")
    labels = VERBAL_LABELS if mode == "compat" else tuple(sorted(VERBAL_LABELS, key=len, reverse=True))
    named = _first(F.regexp_extract(answer, r"[Oo]dpowied[źz]:\s*(" + "|".join(labels) + ")", 1))
    upper = F.upper(answer)
    inside = reduce(lambda acc, lab: F.coalesce(acc, F.when(upper.contains(lab), F.lit(lab))), labels[1:],
                    F.when(upper.contains(labels[0]), F.lit(labels[0])))
    return F.coalesce(named, inside, F.lit(ERROR))


def label_json_field(answer: Column) -> Column:
    """`label` of a JSON answer, ERROR when there is none."""
    return F.coalesce(F.get_json_object(answer, "$.label"), F.lit(ERROR))
