"""CSS selectors of the few forms in use, as SQL over a page's columns ``elements``, ``page_text``, ``hits`` and ``steps``.

The steps of all built-in selectors are one index: a step is listed under its most telling token (id, class, attribute and value,
attribute, tag). ``indexed`` walks a page's elements once, looks up each element's tokens and tests only the steps listed there;
``hits`` are the pairs found, in order of elements, and ``steps`` their steps alone. A built-in selector then reads the hits of its
steps. A selector from elsewhere is tested on the elements themselves, with the same result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.operators.preview import rules

_STEP = re.compile(
    r"""^(?P<tag>[a-z0-9]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]|:(?P<state>first-of-type|last-child)""",
    re.X,
)


def _tests(step: str, node: str) -> str:
    tests = []
    for part in _STEP.finditer(step):
        found = part.groupdict()
        if found["tag"]:
            tests.append(f"{node}.tag = '{found['tag']}'")
        if found["cls"]:
            tests.append(f"array_contains(split({node}.cls, '[ \\\\t\\\\r\\\\n\\\\f]+'), '{found['cls']}')")
        if found["id"]:
            tests.append(f"{node}.id = '{found['id']}'")
        if found["attr"]:
            short = {"class": "cls", "id": "id"}.get(found["attr"])
            value = f"{node}.{short}" if short else f"element_at({node}.attrs, '{found['attr']}')"
            test = {None: "{} IS NOT NULL", "=": "{} = '{}'", "*=": "contains({}, '{}')"}[found["op"]]
            tests.append(test.format(value, found["value"]))
        if found["state"]:
            tests.append(f"{node}.{found['state'].replace('-', '_')}")
    return " AND ".join(tests)


_OUTSIDE = r" (?![^\[]*\])"  # blanks inside an attribute value do not count
META_FORMS = ['meta[name="{}"]', 'meta[property="og:{}"]', 'meta[name="twitter:{}"]']
SELECTORS = [
    *rules.TITLE_METAS, *rules.TITLE_ELEMENTS, *rules.GENERIC_TITLES, *rules.DESCRIPTIONS, *rules.IMAGES, *rules.FAVICONS,
    *[s for listed in rules.SITE.values() for s in listed], "title", "p", "img",
    *[form.format(name) for name in ("title", "description", "author", "image") for form in META_FORMS],
]
STEPS = {step: k for k, step in enumerate(sorted({step for s in SELECTORS for step in re.split(_OUTSIDE, s)}))}


def _token(step: str) -> str:
    """The token that every element the step matches has, and as few others as can be told from the step."""
    found = [part.groupdict() for part in _STEP.finditer(step)]
    forms = [
        ("id", "#{id}"), ("cls", ".{cls}"), ("value", "[{attr}={value}"), ("attr", "[{attr}"), ("tag", "{tag}"),
    ]
    for name, form in forms:
        for part in found:
            if part[name] and (name != "value" or part["op"] == "="):
                return form.format(**part)
    raise ValueError(f"nothing to look up in {step}")


def _index() -> str:
    """SQL map from a token to the steps listed under it."""
    listed: dict[str, list[int]] = {}
    for step, k in STEPS.items():
        listed.setdefault(_token(step), []).append(k)
    return "map(" + ", ".join(f"'{token}', array({', '.join(map(str, ks))})" for token, ks in listed.items()) + ")"


def indexed(scanned: DataFrame) -> DataFrame:
    """Add ``hits`` (step, at, pos, last) and ``steps`` to scanned pages: which built-in steps match which elements."""
    tokens = """concat(array(e.tag), if(e.id IS NULL, array(), array('#' || e.id)),
        if(e.cls IS NULL, array(), transform(split(e.cls, '[ \\\\t\\\\r\\\\n\\\\f]+'), c -> '.' || c)),
        flatten(transform(map_entries(e.attrs), a -> array('[' || a.key, '[' || a.key || '=' || a.value))))"""
    tests = " ".join(f"WHEN {k} THEN {_tests(step, 'e')}" for step, k in STEPS.items())
    listed = f"flatten(filter(transform({tokens}, t -> try_element_at({_index()}, t)), ks -> ks IS NOT NULL))"
    matched = f"filter(array_distinct({listed}), k -> coalesce(CASE k {tests} END, false))"
    hits = f"flatten(transform(elements, (e, i) -> transform({matched}, k -> struct(k AS step, i AS at, e.pos AS pos, e.last AS last))))"
    return scanned.withColumn("hits", F.expr(hits)).withColumn("steps", F.expr("hits.step"))


def matches(selector: str) -> str:
    """SQL for the elements of the page that the selector matches, in order.

    The steps before the last name enclosing elements by class or id; those are looked up once for a page.
    """
    *outer, own = re.split(_OUTSIDE, selector)
    inside = [f"exists(o[{k}], o -> o.pos < e.pos AND e.pos <= o.last)" for k in range(len(outer))]
    own_found = f"filter(elements, e -> coalesce({' AND '.join([_tests(own, 'e'), *inside])}, false))"
    if not outer:
        return own_found
    around = ", ".join(f"filter(elements, e -> coalesce({_tests(step, 'e')}, false))" for step in outer)
    return f"flatten(transform(array(array({around})), o -> {own_found}))"


def _first_hit(own: str, outer: list[str]) -> str:
    """SQL for the first hit of a step of the index inside hits of the outer steps."""
    if not outer:
        return f"get(hits, CAST(array_position(steps, {STEPS[own]}) - 1 AS INT))"
    around = ", ".join(f"filter(hits, h -> h.step = {STEPS[step]})" for step in outer)
    inside = " AND ".join(f"exists(o[{k}], o -> o.pos < h.pos AND h.pos <= o.last)" for k in range(len(outer)))
    return f"get(flatten(transform(array(array({around})), o -> filter(hits, h -> h.step = {STEPS[own]} AND {inside}))), 0)"


def first_sql(selector: str) -> str:
    """SQL for the first element of the page that the selector matches, or NULL."""
    *outer, own = re.split(_OUTSIDE, selector)
    if all(step in STEPS for step in [*outer, own]):
        return f"get(elements, {_first_hit(own, outer)}.at)"
    return f"get({matches(selector)}, 0)"


def first(selector: str) -> Column:
    return F.expr(first_sql(selector))


def attr_sql(name: str, node: str = "e") -> str:
    return f"element_at({node}.attrs, '{name}')"


def text_sql(node: str = "e") -> str:
    return f"CAST(substring(page_text, {node}.start + 1, {node}.until - {node}.start) AS STRING)"


def text_of(element: Column) -> Column:
    """The text inside an element of the page."""
    return F.substring(F.col("page_text"), element["start"] + 1, element["until"] - element["start"]).cast("string")


def pick(selector: str, values: list[str], test: str = "t <> ''") -> Column:
    """The first of ``values`` (SQL over ``e``) of the selector's first element that passes ``test`` (over ``t``)."""
    found = f"filter(array({first_sql(selector)}), e -> e IS NOT NULL)"
    return F.expr(f"get(filter(flatten(transform({found}, e -> array({', '.join(values)}))), t -> {test}), 0)")


def text(selector: str) -> Column:
    """Text of the selector's first element, which may be empty."""
    return pick(selector, [text_sql()], "t IS NOT NULL")


def attr(selector: str, name: str) -> Column:
    """Attribute of the selector's first element; a missing and an empty one are both NULL."""
    return pick(selector, [attr_sql(name)])


def filled(value: Column) -> Column:
    """``value``, or NULL where it is empty; the value is computed once."""
    return F.get(F.filter(F.array(value), lambda t: t != ""), F.lit(0))
