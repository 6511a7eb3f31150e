"""Survey recodes as plain Column expressions.

Every function returns a ``Column`` built from JVM-side expressions, so a whole
cleaning step collapses into one code-generated projection over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary(condition: Column, yes, no) -> Column:
    """Two-way recode that keeps a missing condition missing."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def recode(column: ColumnLike, mapping: Mapping, default=None) -> Column:
    """Map codes to labels.

    A key may be a single code or a tuple/set/frozenset of codes.  Codes outside
    the mapping become missing, or ``default`` when one is given; a missing code
    also takes the default.
    """
    c = _col(column)
    out = None
    for codes, label in mapping.items():
        many = isinstance(codes, (tuple, set, frozenset))
        hit = c.isin(*sorted(codes)) if many else c == F.lit(codes)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    if out is None:
        raise ValueError("recode needs at least one code")
    return out if default is None else out.otherwise(F.lit(default))


def band(column: ColumnLike, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: below the first cut, below the second, ..., the rest.

    A missing value falls into the last band, as in a chained conditional with a
    final default.  Drop it with the complete-case rule if that is not wanted.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("band needs one label more than cuts")
    if list(cuts) != sorted(cuts):
        raise ValueError("band cuts must increase")
    c = _col(column)
    out = F.when(c < F.lit(cuts[0]), F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(c < F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def indicator(condition: Column) -> Column:
    """0/1 double from a condition; missing stays missing."""
    return condition.cast("double")


def any_of(columns: Iterable[ColumnLike], code, null_as_false: bool = False) -> Column:
    """1 when any column equals ``code``, under three-valued logic.

    One match decides even beside missing answers; no match beside a missing
    answer is missing, unless ``null_as_false``.
    """
    hits = [_col(c) == F.lit(code) for c in columns]
    if null_as_false:
        hits = [F.coalesce(h, F.lit(False)) for h in hits]
    return reduce(lambda a, b: a | b, hits).cast("double")


def flip_outcome(column: ColumnLike) -> Column:
    """Code 1 (support) to 1 and code 2 (oppose) to 0; any other code is missing."""
    flipped = F.lit(2) - _col(column)
    return F.when(flipped.isin(0, 1), flipped).cast("double")


def age_in(year: int, birth_year: ColumnLike) -> Column:
    """Age reached during ``year``."""
    return F.lit(year) - _col(birth_year)


def is_member(column: ColumnLike, values: Iterable) -> Column:
    """Membership that is false, never missing, for a missing value."""
    return F.coalesce(_col(column).isin(*values), F.lit(False))


def in_set(column: ColumnLike, values: Iterable) -> Column:
    """Membership for filters; pushes down to the scan as an IN predicate."""
    return _col(column).isin(*values)


def snake_case(name: str) -> str:
    """Lower snake case for one column name."""
    s = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "")
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z][a-z])|(?<=[a-z])(?=[A-Z])", "_", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        return "x"
    return f"x{s}" if s[0].isdigit() else s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeats get ``_2``, ``_3``, ..."""
    taken: set[str] = set()
    names = []
    for raw in df.columns:
        base = name = snake_case(raw)
        i = 1
        while name in taken:
            i += 1
            name = f"{base}_{i}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)
