"""The one Python step: HTML in, plain values out.

Each page is parsed once per job, inside an Arrow-batched function. Only the selector
forms that pattern files use are known: tag, ``#id``, ``.class``, ``[attr]`` with ``=``,
``*=``, ``^=`` and ``$=``, descendants, comma groups, ``::text`` and ``::attr(x)``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never have content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Elements whose text does not count as text of the page around them.
OWN_TEXT_TAGS = frozenset("rt rp style script template".split())
# Elements that keep runs of blanks.
PREFORMATTED_TAGS = frozenset(["pre", "textarea"])
_BLANKS = " \n\t\f\r"


class Element:
    __slots__ = ("index", "tag", "attrs", "parent", "end", "first_text", "last_text")

    def __init__(self, index: int, tag: str, attrs: dict[str, str], parent: "Element | None", text: int):
        self.index, self.tag, self.attrs, self.parent = index, tag, attrs, parent
        self.first_text = text
        self.end = self.last_text = -1


class Page(HTMLParser):
    """Elements in document order; texts are one flat list with a range per element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.kinds: list[str | None] = []
        self.owners: list[Element | None] = []
        self.by_tag: dict[str, list[int]] = {}
        self._open: list[Element] = []
        self._open_count: dict[str, int] = {}
        self._open_own_text: list[str] = []
        self._pending: list[str] = []
        self._closed_void: dict[str, int] = {}
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._close_last()

    # -- building ---------------------------------------------------------------

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def _flush(self) -> None:
        if not self._pending:
            return
        text = "".join(self._pending)
        self._pending.clear()
        if not text.strip(_BLANKS) and not any(map(self._open_count.get, PREFORMATTED_TAGS)):
            text = "\n" if "\n" in text else " "
        self._add(text)

    def _add(self, text: str) -> None:
        self.texts.append(text)
        self.kinds.append(self._open_own_text[-1] if self._open_own_text else None)
        self.owners.append(self._open[-1] if self._open else None)

    def _close_last(self) -> None:
        element = self._open.pop()
        self._open_count[element.tag] -= 1
        if element.tag in OWN_TEXT_TAGS:
            self._open_own_text.pop()
        element.end, element.last_text = len(self.elements), len(self.texts)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._close_last()
            self._closed_void[tag] = self._closed_void.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        self._close_last()

    def _start(self, tag: str, attrs: list) -> None:
        self._flush()
        parent = self._open[-1] if self._open else None
        element = Element(
            len(self.elements), tag, {name: value or "" for name, value in attrs}, parent, len(self.texts)
        )
        self.by_tag.setdefault(tag, []).append(element.index)
        self.elements.append(element)
        self._open.append(element)
        # Counts instead of walks over the open elements, which a broken page may stack up.
        self._open_count[tag] = self._open_count.get(tag, 0) + 1
        if tag in OWN_TEXT_TAGS:
            self._open_own_text.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._closed_void.get(tag):
            self._closed_void[tag] -= 1
            return
        self._flush()
        # A closing tag without its opening one is ignored; there is no implied closing.
        if self._open_count.get(tag):
            while self._open[-1].tag != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_entityref(self, name: str) -> None:
        self._pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name: str) -> None:
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            self._pending.append(
                bytes([code]).decode("windows-1252") if 127 < code < 160 else chr(code)
            )
        except (ValueError, OverflowError):
            self._pending.append("\N{REPLACEMENT CHARACTER}")

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self._add(data[6:])

    # -- reading ----------------------------------------------------------------

    def _strings(self, element: Element | None):
        if element is None:
            first, last, kind = 0, len(self.texts), None
        else:
            first, last = element.first_text, element.last_text
            kind = element.tag if element.tag in OWN_TEXT_TAGS else None
        return (self.texts[i] for i in range(first, last) if self.kinds[i] == kind)

    def text(self, element: Element | None = None) -> str:
        return "".join(self._strings(element))

    def stripped_text(self, element: Element) -> str:
        """Stripped pieces joined without a blank: ``a<b>b</b>`` reads ``ab``."""
        return "".join(filter(None, (text.strip() for text in self._strings(element))))

    def own_texts(self, element: Element) -> list[str]:
        return [
            self.texts[i]
            for i in range(element.first_text, element.last_text)
            if self.owners[i] is element
        ]

    def value(self, element: Element, attribute: str) -> str | None:
        return self.stripped_text(element) if attribute == "text" else element.attrs.get(attribute)


_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[*^$]?=)\s*(?P<quote>[\"']?)(?P<val>.*?)(?P=quote)\s*)?\]"
)
_PSEUDO = re.compile(r"::(text|attr\(([\w:-]+)\))$")


@dataclass(frozen=True)
class Compound:
    """One selector step: an optional tag plus attribute tests."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]

    def accepts(self, element: Element) -> bool:
        if self.tag and element.tag != self.tag:
            return False
        for name, op, expected in self.tests:
            actual = element.attrs.get(name)
            if actual is None:
                return False
            if op == "~=":
                if expected not in actual.split():
                    return False
            elif op == "=":
                if actual != expected:
                    return False
            elif op and not expected:
                return False
            elif op == "*=" and expected not in actual:
                return False
            elif op == "^=" and not actual.startswith(expected):
                return False
            elif op == "$=" and not actual.endswith(expected):
                return False
        return True


@dataclass(frozen=True)
class Selector:
    """A compiled comma group; ``pseudo`` is '', 'text' or an attribute name."""

    branches: tuple[tuple[Compound, ...], ...]
    pseudo: str = ""

    @classmethod
    def compile(cls, css: str) -> "Selector":
        branches, pseudo = [], ""
        for branch in re.split(r",(?![^\[]*\])", css):
            branch = branch.strip()
            ending = _PSEUDO.search(branch)
            if ending:
                pseudo = ending[2] or "text"
                branch = branch[: ending.start()]
            steps = [cls._compound(step, css) for step in re.split(r"\s+(?![^\[]*\])", branch) if step]
            if not steps:
                raise ValueError(f"empty selector in {css!r}")
            branches.append(tuple(steps))
        return cls(tuple(branches), pseudo)

    @staticmethod
    def _compound(step: str, css: str) -> Compound:
        tag, tests, at = None, [], 0
        while at < len(step):
            part = _SIMPLE.match(step, at)
            if not part or (part["tag"] and at):
                raise ValueError(f"selector not supported: {css!r}")
            if part["tag"]:
                tag = None if part["tag"] == "*" else part["tag"].lower()
            elif part["id"]:
                tests.append(("id", "=", part["id"]))
            elif part["cls"]:
                tests.append(("class", "~=", part["cls"]))
            else:
                tests.append((part["name"].lower(), part["op"] or "", part["val"] or ""))
            at = part.end()
        return Compound(tag, tuple(tests))

    def select(self, page: Page, scope: Element | None = None, include_scope: bool = False):
        """Matching elements in document order.

        With ``include_scope`` the scope itself may match and ancestors above it do not
        count, which is how a selector below a link element is read.
        """
        low = 0 if scope is None else scope.index + (0 if include_scope else 1)
        high = len(page.elements) if scope is None else scope.end
        floor = low if include_scope else 0
        found = {i for steps in self.branches for i in self._matches(page, steps, low, high, floor)}
        return [page.elements[index] for index in sorted(found)]

    def first(self, page: Page) -> Element | None:
        """The first match; no more of the page is looked at than it takes."""
        high = len(page.elements)
        firsts = (next(self._matches(page, steps, 0, high, 0), high) for steps in self.branches)
        index = min(firsts)
        return page.elements[index] if index < high else None

    def _matches(self, page: Page, steps: tuple[Compound, ...], low: int, high: int, floor: int):
        last = steps[-1]
        candidates = range(low, high)
        if last.tag:
            indexes = page.by_tag.get(last.tag, [])
            candidates = indexes[bisect_left(indexes, low) : bisect_left(indexes, high)]
        met: dict[int, int] = {}
        for index in candidates:
            element = page.elements[index]
            if last.accepts(element) and self._met(steps, element.parent, floor, met) == len(steps) - 1:
                yield index

    @staticmethod
    def _met(steps: tuple[Compound, ...], node: Element | None, floor: int, met: dict[int, int]) -> int:
        """How many leading steps the node and those around it meet, outermost first.

        ``met`` remembers it per element, so that no element is looked at twice however
        deeply a broken page nests.
        """
        above = []
        while node is not None and node.index >= floor and node.index not in met:
            above.append(node)
            node = node.parent
        count = met[node.index] if node is not None and node.index >= floor else 0
        for node in reversed(above):
            if count < len(steps) - 1 and steps[count].accepts(node):
                count += 1
            met[node.index] = count
        return count


# -- page probes ------------------------------------------------------------------


@dataclass(frozen=True)
class Probe:
    """A value to read from a page.

    kind ``value``: first non-empty value over the selectors in order; ``first``: the
    first match's value; ``values``: all values of all matches; ``exists``: any match;
    ``items``: the ``li`` texts of the first matching container (null without any);
    ``block``: the unstripped text of that container; ``page``: the whole page's text.
    """

    name: str
    kind: str
    selectors: tuple[Selector, ...]
    attribute: str = "text"

    @property
    def arrow_type(self) -> pa.DataType:
        many = self.kind in ("items", "values")
        if self.kind == "exists":
            return pa.bool_()
        return pa.list_(pa.string()) if many else pa.string()

    @property
    def spark_type(self) -> str:
        if self.kind == "exists":
            return "boolean"
        return "array<string>" if self.kind in ("items", "values") else "string"

    def read(self, page: Page) -> Any:
        if self.kind == "page":
            return page.text()
        if self.kind == "exists":
            return any(selector.first(page) is not None for selector in self.selectors)
        if self.kind == "values":
            found = (
                page.value(element, self.attribute)
                for selector in self.selectors
                for element in selector.select(page)
            )
            return [value for value in found if value is not None]
        for selector in self.selectors:
            element = selector.first(page)
            if element is None:
                continue
            if self.kind == "value":
                value = page.value(element, self.attribute)
                if value:
                    return value
            elif self.kind == "first":
                return page.value(element, self.attribute)
            elif self.kind == "block":
                return page.text(element)
            else:
                items = _LIST_ITEM.select(page, element)
                if not items:
                    return None
                texts = (page.stripped_text(item) for item in items)
                return [text for text in texts if len(text) > MIN_ITEM_LENGTH]
        return None


_LIST_ITEM = Selector.compile("li")
MIN_ITEM_LENGTH = 2


#: Characters of pages, and pages, whose values are held as Python objects at once.
PIECE_CHARS, PIECE_PAGES = 1 << 20, 256


def in_pieces(batches: Iterator[pa.Array], read: Callable[[str | None], Any], arrow_type: pa.DataType) -> Iterator[pa.Array]:
    """What ``read`` gives for each page, handed on a few pages at a time.

    A batch has up to ten thousand pages. Their values never are in a worker all at once,
    so what it takes beside the batch does not grow with the batch.
    """
    for batch in batches:
        rows, size = [], 0
        for page in batch:
            html = page.as_py()
            rows.append(read(html))
            size += len(html or "")
            if size >= PIECE_CHARS or len(rows) >= PIECE_PAGES:
                yield pa.array(rows, type=arrow_type)
                rows, size = [], 0
        if rows:
            yield pa.array(rows, type=arrow_type)


@dataclass(frozen=True)
class PageReader:
    """All probes of a job, run over one parse of each page."""

    probes: tuple[Probe, ...]
    error_marks: tuple[str, ...] = field(default=())  # looked for in the page's text
    source_marks: tuple[str, ...] = field(default=())  # looked for in its markup

    def read(self, html: str | None) -> dict[str, Any]:
        row: dict[str, Any] = {"error_page": False, "failure": None}
        if html is None:
            row["failure"] = "no html"
            return row
        try:
            page = Page(html)
            if self.error_marks:
                text = page.text().lower()
                row["error_page"] = any(mark in text for mark in self.error_marks)
            if self.source_marks and not row["error_page"]:
                row["error_page"] = any(mark in html for mark in self.source_marks)
            if not row["error_page"]:
                for probe in self.probes:
                    row[probe.name] = probe.read(page)
        except Exception as err:  # one bad page must not stop the run
            row["failure"] = f"{type(err).__name__}: {err}"
        return row

    def column(self, html: Column) -> Column:
        """An array with one struct per page.

        Used with ``inline_outer``: a generator keeps later filters above the Python step,
        and its outer form derives none itself, so no page is parsed twice.
        """
        arrow_type = pa.struct(
            [("error_page", pa.bool_()), ("failure", pa.string())]
            + [(probe.name, probe.arrow_type) for probe in self.probes]
        )
        fields = ["error_page: boolean", "failure: string"] + [
            f"`{probe.name}`: {probe.spark_type}" for probe in self.probes
        ]
        reader = self

        @F.arrow_udf(f"array<struct<{', '.join(fields)}>>")
        def read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from in_pieces(batches, lambda html: [reader.read(html)], pa.list_(arrow_type))

        return read_pages(html)


def probe(
    name: str, kind: str, selectors: str | list[str] = (), attribute: str = "text"
) -> Probe:
    listed = [selectors] if isinstance(selectors, str) else selectors
    return Probe(name, kind, tuple(Selector.compile(css) for css in listed), attribute)


# -- links ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LinkField:
    name: str
    selector: Selector
    attribute: str
    transform: str | None
    keep_blank: bool

    @classmethod
    def compile(cls, name: str, rule: str | dict) -> "LinkField":
        if isinstance(rule, str):
            return cls(name, Selector.compile(rule), "text", "strip", True)
        return cls(
            name,
            Selector.compile(rule["selector"]),
            rule.get("attribute", "text"),
            rule.get("transform"),
            False,
        )

    def read(self, page: Page, link: Element) -> str | None:
        matches = self.selector.select(page, link, include_scope=True)
        if not matches:
            return None
        if self.selector.pseudo == "text":
            value = next((text for match in matches for text in page.own_texts(match)), None)
        elif self.selector.pseudo:
            value = next(
                (m.attrs[self.selector.pseudo] for m in matches if self.selector.pseudo in m.attrs), None
            )
        elif self.attribute == "text":
            value = page.text(matches[0])
        else:
            value = matches[0].attrs.get(self.attribute)
        if value is None or (not value and not self.keep_blank):
            return None
        if self.transform in ("strip", "lower", "upper"):
            value = getattr(value, self.transform)()
        return value


@dataclass(frozen=True)
class LinkRule:
    selector: Selector
    attribute: str
    fields: tuple[LinkField, ...]

    @classmethod
    def compile(cls, rule: dict) -> "LinkRule":
        fields = []
        for name, field_rule in (rule.get("metadata") or {}).items():
            try:
                fields.append(LinkField.compile(name, field_rule))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue  # a bad metadata rule costs that field only
        return cls(Selector.compile(rule["selector"]), rule.get("attribute") or "href", tuple(fields))

    def read(self, page: Page):
        for element in self.selector.select(page):
            link = page.text(element) if self.attribute == "text" else element.attrs.get(self.attribute)
            if link:
                values = ((f.name, f.read(page, element)) for f in self.fields)
                yield {"link": link, "metadata": [(k, v) for k, v in values if v is not None]}


def page_links(html: Column, selector_rules: list[dict]) -> Column:
    """``links`` of a page in selector and document order, each with its metadata map.

    A page that cannot be read has no links and a ``failure``, which is null otherwise.
    """
    rules = [LinkRule.compile(rule) for rule in selector_rules]
    links_type = pa.list_(
        pa.struct([("link", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
    )
    arrow_type = pa.struct([("links", links_type), ("failure", pa.string())])

    @F.arrow_udf("struct<links: array<struct<link: string, metadata: map<string,string>>>, failure: string>")
    def read_links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, lambda html: links_of(html, rules), arrow_type)

    return read_links(html)


def links_of(html: str | None, rules: list[LinkRule]) -> dict:
    """The links of one page, or why it has none."""
    try:
        page = Page(html or "")
        return {"links": [link for rule in rules for link in rule.read(page)], "failure": None}
    except Exception as err:  # as in the crawl, a bad page yields no links
        return {"links": [], "failure": f"{type(err).__name__}: {err}"}
