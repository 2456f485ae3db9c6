"""Hash expressions: sampling order, hash fractions, folds and text fingerprints.

Every sample, shuffle, fold and holdout in the package is decided by SHA-256 of an id, so a result never depends on
how the data happens to be partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() sees it (Unicode spaces plus the four ASCII separators).
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_order(seed, *ids) -> Column:
    """Sort key of a row: sha256 of the seed and the row's id columns."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[_c(i).cast("string") for i in ids]), 256)


def hash_fraction(col) -> Column:
    """The first 32 bits of sha256 as a fraction between 0 and 1."""
    return F.conv(F.substring(F.sha2(_c(col).cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_int(col) -> Column:
    """The first 32 bits of sha256 as a whole number."""
    return F.conv(F.substring(F.sha2(_c(col).cast("string"), 256), 1, 8), 16, 10).cast("bigint")


def half(col) -> Column:
    """Fold 0 or 1: parity of the first byte of sha256."""
    return F.conv(F.substring(F.sha2(_c(col).cast("string"), 256), 1, 2), 16, 10).cast("int") % 2


def held_out(col, share: float = 0.1) -> Column:
    """A fixed share of ids, decided by the id alone."""
    return hash_fraction(col) < F.lit(float(share))


def normalised(col) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(col)), SPACE_RUN, " "))


def text_hash(col) -> Column:
    """Fingerprint of a text: lower case, runs of whitespace as one space, sha256, 20 hex digits."""
    return F.substring(F.sha2(normalised(col), 256), 1, 20)


def canonical_json(col) -> Column:
    """JSON text with sorted keys and no spaces; a variant keeps its object fields sorted. Other text becomes a JSON string."""
    quoted = F.to_json(F.array(_c(col)))
    return F.coalesce(F.to_json(F.try_parse_json(_c(col))), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def state_hash(col) -> Column:
    """First 16 hex digits of sha256 over the canonical JSON of a state."""
    return F.substring(F.sha2(canonical_json(col), 256), 1, 16)
