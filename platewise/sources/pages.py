"""HTML pages (S5, P13, F9): the facts that ingestion needs, by one tolerant pass of the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The class of the breadcrumb list, and the marker of the script that holds the record.
BREADCRUMB = "breadcrumb__list body-copy-extra-small oflow-x-auto list"
SCRIPT_MARK = ("data-testid", "page-schema")
#: The second item that recipe pages have, and the third that collections have.
SECTION, COLLECTION = "Recipes", "Collection"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.crumbs: list[str] | None = None
        self.record: str | None = None
        self._in: str | None = None
        self._lists = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = dict(attrs)
        if tag == "title" and self.title is None:
            self.title, self._in = "", "title"
        elif tag == "script" and self.record is None and has.get(SCRIPT_MARK[0]) == SCRIPT_MARK[1]:
            self.record, self._in = "", "script"
        elif tag == "ul" and (self._lists or self.crumbs is None and has.get("class") == BREADCRUMB):
            self.crumbs = self.crumbs or []
            self._lists += 1
        elif tag == "li" and self._lists:
            self.crumbs.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == self._in:
            self._in = None
        elif tag == "ul" and self._lists:
            self._lists -= 1

    def handle_data(self, data: str) -> None:
        if self._in == "title":
            self.title += data
        elif self._in == "script":
            self.record += data
        elif self._lists and self.crumbs:
            self.crumbs[-1] += data


def page_facts(html: str | None) -> tuple[str, bool, str | None]:
    """(title or '', whether it is a recipe page, text of the record script or None) of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    crumbs = page.crumbs or []
    recipe = len(crumbs) > 2 and crumbs[1] == SECTION and crumbs[2] != COLLECTION
    return page.title or "", recipe, page.record


_FACTS = pa.struct([("title", pa.string()), ("is_recipe", pa.bool_()), ("record", pa.string())])


@F.arrow_udf(T.StructType().add("title", "string").add("is_recipe", "boolean").add("record", "string"))
def _facts(pages: pa.Array) -> pa.Array:
    facts = [dict(zip(("title", "is_recipe", "record"), page_facts(p))) for p in pages.to_pylist()]
    return pa.array(facts, _FACTS)


def facts(html: Column) -> Column:
    """A struct of title, is_recipe and record for each page. Fewer than three breadcrumbs are no recipe page."""
    return _facts.asNondeterministic()(html)
