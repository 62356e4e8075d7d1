"""Filters of either language, and chains of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame

from cartweave.errors import FilterSyntaxError
from cartweave.plans import cel, osmfilter

Filter = Callable[[DataFrame], DataFrame]

#: Programs of more statements are interpreted over Arrow batches instead of planned.
LONG_PROGRAM = 150


def compile_filter(text: str, decode_escapes: bool = False) -> Filter:
    """A function of DataFrames. The text is an OSMFilter program if it reads as one, else a CEL expression."""
    try:
        program = osmfilter.parse(text, decode_escapes)
    except FilterSyntaxError as e:
        first = e
    else:
        long = sum(1 for _ in osmfilter.walk(program.body)) > LONG_PROGRAM
        return lambda elements: (osmfilter.apply_by_rows if long else osmfilter.apply)(program, elements)
    try:
        condition = cel.compile_condition(text)
    except FilterSyntaxError as e:
        raise FilterSyntaxError(f"neither an OSMFilter program ({first}) nor a CEL expression ({e})") from e
    return lambda elements: elements.where(condition)


def apply_filters(elements: DataFrame, texts: Iterable[str], decode_escapes: bool = False) -> DataFrame:
    """Each filter sees what the one before has left. All are compiled before the first is applied."""
    filters = [compile_filter(t, decode_escapes) for t in texts]
    return reduce(DataFrame.transform, filters, elements)
