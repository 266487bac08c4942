"""One pass over page HTML that lists the elements the preview rules can look at.

This is the only step outside the JVM: Arrow batches of pages go to the standard library's HTML tokenizer
and come back as one text and one array of elements per page. Every page is read whole, where its file's split is read: HTML
is under no exchange.

A page's elements are a tree labelled by intervals. ``pos`` counts all elements of the page; an element holds those with a
``pos`` above its own and up to its ``last``. Its text is the bytes from ``start`` to ``until`` of ``page_text``, the UTF-8 of all the
page's character data. So no text and no ancestor is written twice, and a result is as long as its page however deep that nests.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from storelytics.operators.preview.select import indexed

ELEMENTS = (
    "array<struct<pos:int, last:int, tag:string, id:string, cls:string, attrs:map<string,string>, start:int, until:int, "
    "first_of_type:boolean, last_child:boolean>>"
)
_ELEMENT = pa.struct(
    [
        ("pos", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("cls", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("until", pa.int32()),
        ("first_of_type", pa.bool_()), ("last_child", pa.bool_()),
    ]
)

# Fixed values of the HTML standard: elements without content, and those that end an open paragraph.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
# Elements as Python objects take many times the room of their page; a step's pages share about this many characters.
STEP_CHARS = 1 << 18
ALWAYS_LISTED = {"title", "meta", "h1", "p", "img", "link"}


class _Scan(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.listed: list[dict] = []
        self.text: list[bytes] = []
        self.size = 0
        self.open: list[dict] = [self._node("", None, False)]
        self.open_tags: Counter = Counter()
        self.seen = 0

    @staticmethod
    def _node(tag, element, named):
        return {"tag": tag, "element": element, "named": named, "kinds": set(), "last": None}

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close("p")
        if tag == "li" and self.open[-1]["tag"] == "li":
            self._close("li")
        values = {}
        for name, value in attrs:  # the first of repeated attributes counts
            values.setdefault(name, value or "")
        parent = self.open[-1]
        element = self._list(tag, values, tag not in parent["kinds"], parent["named"])
        parent["kinds"].add(tag)
        parent["last"] = element
        if tag not in VOID:
            named = parent["named"] or bool(values.get("id") or values.get("class"))
            self.open.append(self._node(tag, element, named))
            self.open_tags[tag] += 1

    def _list(self, tag, values, first, inside_named):
        self.seen += 1
        wanted = (
            tag in ALWAYS_LISTED or (tag == "script" and values.get("type") == "application/ld+json")
            or any(values.get(k, "").strip() for k in ("class", "id", "data-testid")) or (inside_named and tag in ("li", "span"))
            or any(k.startswith("data-") for k in values)
        )
        if not wanted:
            return None
        element = {
            "pos": self.seen, "last": self.seen, "tag": tag, "id": values.get("id"), "cls": values.get("class"),
            "attrs": list(values.items()), "start": self.size, "until": self.size, "first_of_type": first, "last_child": False,
        }
        self.listed.append(element)
        return element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self._close(tag) and tag == "p":  # a stray </p> stands for an empty paragraph
            self.handle_starttag("p", [])
            self._close("p")

    def _close(self, tag) -> bool:
        if not self.open_tags[tag]:
            return False
        while True:
            node = self.open.pop()
            self.open_tags[node["tag"]] -= 1
            self._finish(node)
            if node["tag"] == tag:
                return True

    def _finish(self, node):
        if node["last"] is not None:
            node["last"]["last_child"] = True
        if node["element"] is not None:
            node["element"].update(last=self.seen, until=self.size)

    def handle_data(self, data):
        self.text.append(data.encode("utf-8", "replace"))
        self.size += len(self.text[-1])

    def page(self, html: str) -> tuple[bytes, list[dict]]:
        self.feed(html)
        self.close()
        while self.open:
            self._finish(self.open.pop())
        return b"".join(self.text), self.listed


def _listed(html: str | None) -> tuple[bytes, list[dict]]:
    """Text and elements of one page; a page the tokenizer cannot read has none."""
    try:
        return _Scan().page(html or "")
    except (AssertionError, ValueError):
        return b"", []


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of each batch in steps of about ``STEP_CHARS``, so memory follows a step and not the batch."""
    for batch in batches:
        texts, lists, held, begin = [], [], 0, 0
        for at, html in enumerate(batch.column("html"), 1):
            html = html.as_py()
            text, listed = _listed(html)
            texts.append(text)
            lists.append(listed)
            held += len(html or "")
            if held >= STEP_CHARS or at == len(batch):
                step = batch.slice(begin, at - begin)
                columns = [step.column("page_id"), step.column("url"), pa.array(texts, pa.binary()), pa.array(lists, pa.list_(_ELEMENT))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "page_text", "elements"])
                texts, lists, held, begin = [], [], 0, at


# Executors need not have this package installed: the scan travels to them with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, url, page_text, elements, hits, steps) for ``pages`` (page_id, url, html); a null page has no text and no elements.

    ``hits`` and ``steps`` are the index of the built-in selectors; a query that does not use them does not compute them.
    """
    needed = pages.select("page_id", "url", "html")
    return indexed(needed.mapInArrow(_scan_batches, f"page_id long, url string, page_text binary, elements {ELEMENTS}"))
