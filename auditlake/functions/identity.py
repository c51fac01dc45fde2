"""Is a class or id token structural, or generated noise?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
GENERATED_PREFIX = r"(?i)^(sc-[a-z0-9]{4,}|css-[a-z0-9]{4,}|emotion-|jsx-\d+|svelte-[a-z0-9]{5,}|v-[0-9a-f]{6,})"
VOLATILE = r"(?i)(^|-)(\d{2,}|[0-9a-f]{8,}|active|open|current|selected|hover|focus|visible|hidden|loaded|js-)"
JUNK = ["false", "true", "undefined", "null", "nan", "none", "object"]
GENERATED_ID = r"(?i)^(:|[0-9a-f]{8,})"


def is_junk(token: Column) -> Column:
    return F.lower(token).isin(JUNK)


def syntactically_stable(token: Column) -> Column:
    """First barrier, frequency unknown."""
    return (
        (F.length(token) > 0)
        & (F.length(token) <= 40)
        & ~is_junk(token)
        & ~token.rlike(VOLATILE)
        & ~token.rlike(GENERATED_PREFIX)
    )


def is_bare_word(token: Column) -> Column:
    """No separator: cannot be told from a hash by sight."""
    return ~token.contains("-") & ~token.contains("_")


def looks_hashed(token: Column) -> Column:
    """Junk literal, inner upper-case letter, or no vowel (D3)."""
    return is_junk(token) | token.rlike(r"^.[\s\S]*[A-Z]") | ~token.rlike(r"(?i)[aeiouy]")


def page_usable_id(token: Column) -> Column:
    """Id fit for a CSS path: no colon, not volatile, not generated."""
    return (
        (F.length(token) > 0)
        & ~token.contains(":")
        & ~token.rlike(VOLATILE)
        & ~token.rlike(GENERATED_PREFIX)
    )


def signature_usable_id(token: Column) -> Column:
    """Id fit for a signature before the registry is asked."""
    return (F.length(token) > 0) & ~token.contains(":") & ~token.rlike(GENERATED_ID)
