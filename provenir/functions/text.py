"""Text predicates and the visible encoding of grouping values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The record rule's default; a stricter or looser rule is an argument.
MAX_SOURCE_ID_LENGTH = 256

# Bidirectional controls, zero-width characters, the C0 controls
# except TAB and LF, and DEL.
HIDDEN_CODE_POINTS = (
    [0x061C, 0x200E, 0x200F]
    + [0x202A, 0x202B, 0x202C, 0x202D, 0x202E]
    + [0x2066, 0x2067, 0x2068, 0x2069]
    + [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
    + list(range(0x00, 0x09))
    + list(range(0x0B, 0x20))
    + [0x7F]
)
_HIDDEN_CLASS = "[" + "".join(f"\\u{cp:04x}" for cp in HIDDEN_CODE_POINTS) + "]"
_SPACE = r"[\s\x1c-\x1f]"


def is_blank(c: Column) -> Column:
    """Empty or white space only, by Unicode's notion of white space."""
    return c.rlike(rf"(?U)\A{_SPACE}*\z")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def has_hidden(c: Column) -> Column:
    return c.rlike(_HIDDEN_CLASS)


def neutralize(c: Column) -> Column:
    """Write hidden code points as ``\\uXXXX``; injective.

    Backslashes are doubled first, so a spelled-out placeholder in the input
    cannot meet a real one in the output.
    """
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    shown = doubled
    for cp in HIDDEN_CODE_POINTS:
        shown = F.replace(shown, F.lit(chr(cp)), F.lit(f"\\u{cp:04X}"))
    return F.when(has_hidden(c), shown).otherwise(doubled)


def source_id_problem(c: Column, max_length: int = MAX_SOURCE_ID_LENGTH) -> Column:
    """Why a declared source id is not acceptable; null when it is."""
    return (
        F.when(c.isNull(), None)
        .when(c == "", "source_id is empty")
        .when(c.rlike(rf"(?U)\A{_SPACE}|{_SPACE}\z"), "source_id has outer white space")
        .when(F.length(c) > max_length, "source_id is too long")
        .when(has_hidden(c), "source_id holds hidden characters")
    )


def neutral_label(prefix: str, rank: Column) -> Column:
    """``N-01`` style labels from a 1-based rank."""
    return F.concat(F.lit(f"{prefix}-"), F.when(rank < 10, F.concat(F.lit("0"), rank.cast("string"))).otherwise(rank.cast("string")))


def is_pairwise_question(question_id: Column) -> Column:
    return ~F.endswith(question_id, F.lit("-q-single"))
