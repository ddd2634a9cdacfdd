"""Functions on collections: array columns in document order. A null array counts as an empty collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Item = Callable[..., Column]


def items(c: Column) -> Column:
    """The collection without nulls; empty for a null array."""
    return F.coalesce(F.array_compact(c), F.array_compact(F.slice(c, 1, 0)), F.array())


def one(c: Column) -> Column:
    """A plain column as a collection of at most one item."""
    return F.array_compact(F.array(c))


def _takes_index(f: Item) -> bool:
    return f.__code__.co_argcount == 2


def where(c: Column, criteria: Item) -> Column:
    """Items whose criteria is true; unknown drops. criteria(item) or criteria(item, index from 0)."""
    if _takes_index(criteria):
        return F.filter(c, lambda e, i: F.coalesce(criteria(e, i), F.lit(False)))
    return F.filter(c, lambda e: F.coalesce(criteria(e), F.lit(False)))


def select(c: Column, projection: Item) -> Column:
    """One result for each item, empty ones left out."""
    if _takes_index(projection):
        return F.array_compact(F.transform(c, lambda e, i: projection(e, i)))
    return F.array_compact(F.transform(c, lambda e: projection(e)))


def select_many(c: Column, projection: Item) -> Column:
    """The results of all items, each a collection, as one collection."""
    return F.flatten(F.transform(c, lambda e: F.coalesce(projection(e), F.array())))


def exists(c: Column, criteria: Item | None = None) -> Column:
    """Whether any item meets the criteria, or there is any item."""
    if criteria is None:
        return count(c) > 0
    return F.coalesce(F.exists(c, lambda e: F.coalesce(criteria(e), F.lit(False))), F.lit(False))


def all_(c: Column, criteria: Item) -> Column:
    """Whether every item meets the criteria; unknown does not. True for none."""
    return F.coalesce(F.forall(c, lambda e: F.coalesce(criteria(e), F.lit(False))), F.lit(True))


def count(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("long")


def empty(c: Column) -> Column:
    return count(c) == 0


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def item_at(c: Column, n: int) -> Column:
    """The item at n from 0; empty out of range."""
    return F.get(c, F.lit(n))


def tail(c: Column) -> Column:
    return skip(c, 1)


def skip(c: Column, n: int) -> Column:
    return c if n <= 0 else F.filter(c, lambda e, i: i >= n)


def take(c: Column, n: int) -> Column:
    return F.slice(c, 1, max(n, 0))


def single(c: Column) -> Column:
    """The only item; empty if none, an error if several."""
    return F.when(F.size(c) > 1, F.raise_error(F.lit("a single item was expected"))).otherwise(first(c))


def distinct(c: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(c)


def is_distinct(c: Column) -> Column:
    return count(F.array_distinct(c)) == count(c)


def union(a: Column, b: Column) -> Column:
    """Distinct items of both, first seen first."""
    return F.array_union(a, b)


def combine(a: Column, b: Column) -> Column:
    """All items of a, then of b."""
    return F.concat(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def exclude(a: Column, b: Column) -> Column:
    """Items of a that b lacks, repeats kept."""
    return F.filter(a, lambda e: ~F.array_contains(b, e))


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def superset_of(a: Column, b: Column) -> Column:
    return subset_of(b, a)


def in_(value: Column, c: Column) -> Column:
    """Whether the collection holds the value; empty for no value, unknown equality counts as none."""
    return F.when(value.isNotNull(), F.coalesce(F.array_contains(c, value), F.lit(False)))


def contains(c: Column, value: Column) -> Column:
    return in_(value, c)


def aggregate(c: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """A fold in order: step(total, item)."""
    return F.aggregate(c, start, lambda total, e: step(total, e))


def sum_(c: Column, kind: str = "double") -> Column:
    """Sum; empty for none."""
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast(kind), lambda t, e: (t + e).cast(kind)))


def avg(c: Column) -> Column:
    return F.try_divide(sum_(c), F.size(c))


def min_(c: Column) -> Column:
    return F.array_min(c)


def max_(c: Column) -> Column:
    return F.array_max(c)


def all_true(c: Column) -> Column:
    return F.coalesce(F.forall(c, lambda e: e), F.lit(True))


def any_true(c: Column) -> Column:
    return F.coalesce(F.exists(c, lambda e: e), F.lit(False))


def all_false(c: Column) -> Column:
    return F.coalesce(F.forall(c, lambda e: ~e), F.lit(True))


def any_false(c: Column) -> Column:
    return F.coalesce(F.exists(c, lambda e: ~e), F.lit(False))


def sort(c: Column, *keys: tuple[Item, bool]) -> Column:
    """Stable sort by keys, each (of an item, descending). Empty keys are lowest. No keys: by the items themselves."""
    if not keys:
        return F.array_sort(c)

    def before(a: Column, b: Column) -> Column:
        out = a["i"].cast("int") - b["i"].cast("int")
        for n, (_, descending) in reversed(list(enumerate(keys))):
            x, y = a[f"k{n}"], b[f"k{n}"]
            low, high = (1, -1) if descending else (-1, 1)
            out = (
                F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(low)).when(y.isNull(), F.lit(high))
                .when(x < y, F.lit(low)).when(x > y, F.lit(high)).otherwise(out)
            )
        return out

    keyed = F.transform(c, lambda e, i: F.struct(*(k(e).alias(f"k{n}") for n, (k, _) in enumerate(keys)), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed, before), lambda s: s["e"])


def iif(criteria: Column, then: Column, otherwise: Column | None = None) -> Column:
    """then if criteria is true, otherwise the other, or empty; unknown counts as not."""
    out = F.when(F.coalesce(criteria, F.lit(False)), then)
    return out if otherwise is None else out.otherwise(otherwise)


def coalesce(*collections: Column) -> Column:
    """The first collection that has an item; plain columns by null."""
    return F.coalesce(*collections)


def coalesce_items(*collections: Column) -> Column:
    """The first array that has an item; empty if none has."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in collections), F.slice(collections[0], 1, 0))


def equal(a: Column, b: Column) -> Column:
    """Same items in the same order; empty if either is."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.size(a) != F.size(b), False).otherwise(
        F.aggregate(F.zip_with(a, b, lambda x, y: x == y), F.lit(True), lambda t, e: t & e)))


def equivalent(a: Column, b: Column) -> Column:
    """Same items in any order, with repeats; two empty collections are."""
    return F.coalesce(F.sort_array(a) == F.sort_array(b), F.size(a) == F.size(b), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A defined variable: body(value), value computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trace(c: Column, name: str, projection: Item | None = None) -> Column:
    """The collection as it is; DataFrame.observe() is the place for what a trace would log."""
    return c


def of_type(c: Column, tag: str, kind: str) -> Column:
    """Items of a tagged collection (struct with a `tag` field) that have this kind."""
    return F.filter(c, lambda e: F.coalesce(e[tag] == kind, F.lit(False)))


def conforms_to(resource_type: Column, url: str, prefix: str = "http://hl7.org/fhir/StructureDefinition/") -> Column:
    """Whether the discriminator is the type the url names; an error for urls of another form."""
    if not url.startswith(prefix):
        return F.raise_error(F.lit(f"not a type url: {url}"))
    return resource_type == url[len(prefix) :]


def extension(primitive: Column, url: str) -> Column:
    """The extensions with this url of an element that has some (struct<..., extension array<struct<url, ...>>>)."""
    return F.filter(primitive["extension"], lambda e: e["url"] == url)


def has_value(primitive: Column) -> Column:
    """Whether a primitive has a value beside its metadata; empty for an empty one."""
    return F.when(primitive.isNotNull(), primitive["value"].isNotNull())


def get_value(primitive: Column) -> Column:
    return primitive["value"]
