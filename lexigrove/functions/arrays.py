"""Array and map expressions that the annotators are built from. All stay in the JVM and inside a row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed together; the cost of a running sum of n elements is about n * CHUNK + (n / CHUNK) ** 2.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it, also in its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(value: Column) -> Column:
    """``value`` itself, in a form below which the optimizer pushes no filter.

    A filter on an annotation would else be rewritten as a filter on the text, and all annotators would run again for it.
    """
    return F.when(F.rand(0) + 1 > 0, value)  # always true, but only at run time


def _running(part: Column) -> Column:
    zero = F.array().cast("array<int>")
    return F.aggregate(
        part, zero, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    )


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an ``array<int>`` column, in two levels of chunks."""

    def summed(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda c: _running(F.slice(v, (c - 1) * CHUNK + 1, F.lit(CHUNK))))
        return let(chunks, lambda parts: _joined(parts))

    return let(values, summed)


def _joined(parts: Column) -> Column:
    ends = _running(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
    bases = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.filter(F.zip_with(parts, bases, lambda p, b: F.transform(p, lambda x: x + b)), lambda p: p.isNotNull()))


#: Characters from one stretch of a text to the next; each holds two.
STRETCH = 512


def stretches(text: Column) -> Column:
    """Overlapping parts of a text, so that :func:`cut_of` need not count from the text's begin: texts are counted character by
    character, which for all tokens of a long one would cost its square."""
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / F.lit(STRETCH)).cast("int"))
    return F.transform(starts, lambda k: F.substring(text, k * STRETCH + 1, F.lit(2 * STRETCH)))


def cut_of(parts: Column, text: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end) of a text with these stretches."""
    part = F.substring(at(parts, F.floor(begin / F.lit(STRETCH)).cast("int")), begin % STRETCH + 1, end - begin)
    return F.when(end - begin <= STRETCH, part).otherwise(F.substring(text, begin + 1, end - begin))


def at(values: Column, index: Column | int) -> Column:
    """Element ``index`` from 0, or null outside."""
    return F.get(values, F.lit(index) if isinstance(index, int) else index)


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def drop_take(values: Column, begin: Column, end: Column) -> Column:
    """Elements [begin, end) from 0; as many as there are."""
    return F.slice(values, begin + 1, F.greatest(end - begin, F.lit(0)))


def has_some(value: Column, is_collection: bool = False) -> Column:
    """Whether a value counts as data: not null, not false, and not an empty collection. Empty strings count."""
    return F.coalesce(F.size(value) > 0, F.lit(False)) if is_collection else value.isNotNull()


def if_some(value: Column) -> Column:
    """A collection, or null if it is empty."""
    return F.when(F.size(value) > 0, value)


def merge_with_add(a: Column, b: Column) -> Column:
    """Maps of numbers merged, values of equal keys added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def select_keys(values: Column, keys: list) -> Column:
    return F.map_filter(values, lambda k, _: k.isin(keys))


def get_or(values: Column, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(values, key), F.lit(default))


def count_if(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, lambda x: F.coalesce(test(x), F.lit(False))))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient as double; 0 if ``whole`` is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
