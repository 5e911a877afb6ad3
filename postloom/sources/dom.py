"""HTML pages -> one array of element and text nodes per page.

This is the only Python worker code in the package.  It flattens a page in
document order; every extraction rule is a Column expression over the result.
A subtree is the contiguous slice ``[nid, nid + size)``, so no rule needs a
join or a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import bind, strip

# executors get the worker code with the plan and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = {
    "nid": "int", "size": "int", "tag": "string", "attrs": "map<string,string>", "text": "string", "only": "string",
    "text_len": "int", "parent": "int", "depth": "int",
}
_ARROW = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_ROWS_PER_SLICE = 64

# Kinds of text nodes, void elements and implied end tags of HTML.
TEXT, RAW_TEXT, COMMENT = "#text", "#raw", "#comment"
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "template"}
_BLOCK = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
_PARAGRAPH = {"p"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
            "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body"}


class _Flattener(HTMLParser):
    """Collects the nodes of one page as parallel lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[list[tuple[str, str]]] = []
        self.texts: list[str | None] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: list, text: str | None) -> int:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.parents.append(self.open[-1] if self.open else -1)
        self.depths.append(self.depths[self.open[-1]] + 1 if self.open else 0)
        return len(self.tags) - 1

    def _close_implied(self, tag: str) -> None:
        ends = _SIBLING.get(tag) or (_PARAGRAPH if tag in _BLOCK else None)
        if not ends:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tags[self.open[depth]]
            if name in ends:
                del self.open[depth:]
                if tag not in _SIBLING:
                    return
            elif name in _SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        seen: dict[str, str] = {}
        for key, value in attrs:
            seen.setdefault(key, value or "")
        nid = self._add(tag, list(seen.items()), None)
        if tag not in _VOID:
            self.open.append(nid)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[depth]] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        raw = bool(self.open) and self.tags[self.open[-1]] in _RAW
        kind = RAW_TEXT if raw else TEXT
        holder = self.open[-1] if self.open else -1
        if self.tags and self.tags[-1] == kind and self.parents[-1] == holder:
            self.texts[-1] += data  # the parser may hand one text over in parts
        else:
            self._add(kind, [], data)

    def handle_comment(self, data):
        self._add(COMMENT, [], data)

    def totals(self) -> tuple[list[int], list[str | None], list[int]]:
        """Per node: nodes below it and itself, text of a lone child, visible characters."""
        count = len(self.tags)
        sizes, children = [1] * count, [0] * count
        only: list[str | None] = [None] * count
        lengths = [
            len(text.strip()) if tag == TEXT else 0 for tag, text in zip(self.tags, self.texts, strict=True)
        ]
        for nid in range(count - 1, -1, -1):
            parent = self.parents[nid]
            if parent < 0:
                continue
            sizes[parent] += sizes[nid]
            lengths[parent] += lengths[nid]
            children[parent] += 1
            # nodes come last to first, so the count is final at the first child
            own = self.texts[nid] if self.texts[nid] is not None else only[nid]
            only[parent] = own if children[parent] == 1 else None
        return sizes, only, lengths


def _page(html: str | None) -> _Flattener:
    parser = _Flattener()
    parser.feed(html or "")
    parser.close()
    return parser


def _offsets(lengths) -> pa.Array:
    return pa.array(list(accumulate(lengths, initial=0)), type=pa.int32())


def _node_lists(pages: list[_Flattener], fields: list[str]) -> pa.Array:
    """One list of node structs per page, put together column by column."""
    flat = lambda rows: list(chain.from_iterable(rows))
    totals = [p.totals() for p in pages] if {"size", "only", "text_len"} & set(fields) else []

    def attributes():
        attrs = flat(p.attrs for p in pages)
        pairs = flat(attrs)
        return pa.MapArray.from_arrays(
            _offsets(map(len, attrs)),
            pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()),
        )

    makers = {
        "nid": lambda: flat(range(len(p.tags)) for p in pages),
        "size": lambda: flat(t[0] for t in totals),
        "tag": lambda: flat(p.tags for p in pages),
        "attrs": attributes,
        "text": lambda: flat(p.texts for p in pages),
        "only": lambda: flat(t[1] for t in totals),
        "text_len": lambda: flat(t[2] for t in totals),
        "parent": lambda: flat(p.parents for p in pages),
        "depth": lambda: flat(p.depths for p in pages),
    }
    kinds = [_ARROW[FIELDS[f]] for f in fields]
    made = [makers[f]() for f in fields]
    columns = [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, kind in zip(made, kinds)]
    nodes = pa.StructArray.from_arrays(columns, fields=[pa.field(f, kind) for f, kind in zip(fields, kinds)])
    return pa.ListArray.from_arrays(_offsets(len(p.tags) for p in pages), nodes)


def _flattener(fields: list[str]):
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_PER_SLICE):
                part = batch.slice(start, _ROWS_PER_SLICE)
                html = part.column(part.schema.get_field_index("html")).to_pylist()
                nodes = _node_lists([_page(page) for page in html], fields)
                keep = [i for i, name in enumerate(part.schema.names) if name != "html"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in keep] + [nodes],
                    names=[part.schema.names[i] for i in keep] + ["nodes"],
                )

    return flatten


def with_nodes(pages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Replace the ``html`` column by ``nodes``, with all FIELDS or those wanted."""
    fields = list(fields or FIELDS)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"]
    node = ",".join(f"{f}:{FIELDS[f]}" for f in fields)
    return pages.mapInArrow(_flattener(fields), ", ".join([*kept, f"nodes array<struct<{node}>>"]))


def subtree(nodes: Column, node: Column) -> Column:
    """The node itself and everything below it, in document order.

    ``nodes`` may be a page or a subtree that holds the node.
    """
    return F.slice(nodes, node["nid"] - F.get(nodes, 0)["nid"] + 1, node["size"])


def is_element(n: Column) -> Column:
    return ~F.startswith(n["tag"], F.lit("#"))


def attr(n: Column, name: str) -> Column:
    """Attribute value; a missing one reads as ''."""
    return F.coalesce(n["attrs"][name], F.lit(""))


def has_class(n: Column, name: str) -> Column:
    css = attr(n, "class")
    # the plain search spares most nodes the split
    return F.contains(css, F.lit(name)) & F.array_contains(F.split(css, r"\s+"), name)


def first_node(nodes: Column, rule) -> Column:
    return F.get(F.filter(nodes, rule), 0)


def _climb(nodes: Column, node: Column, start: Column, step) -> Column:
    """Go from a node of a whole page to the root by way of the parents, one step per level.

    ``step(at, n, state)`` gives the state after meeting ancestor ``n``, whose number is ``at``.
    """
    levels = F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])).otherwise(F.array().cast("array<int>"))
    begin = F.struct(node["parent"].alias("at"), start.alias("state"))

    def up(x, _):
        n = F.get(nodes, x["at"])
        return F.struct(n["parent"].alias("at"), step(x["at"], n, x["state"]).alias("state"))

    return F.aggregate(levels, begin, up, lambda x: x["state"])


def _held(nodes: Column, found: Column) -> Column:
    return F.when(found >= 0, F.get(nodes, found))


def nearest_above(nodes: Column, node: Column, *rules) -> Column:
    """The nearest ancestor that the first of the rules to hold for any ancestor holds for; null without one."""
    def find(rule):
        return _held(nodes, _climb(
            nodes, node, F.lit(-1), lambda at, n, found: F.when(found >= 0, found).when(rule(n), at).otherwise(found)))

    return F.coalesce(*[find(rule) for rule in rules])


def outermost_above(nodes: Column, node: Column, rule) -> Column:
    return _held(nodes, _climb(nodes, node, F.lit(-1), lambda at, n, found: F.when(rule(n), at).otherwise(found)))


def nearest_within(nodes: Column, node: Column, rule, steps: int, skip) -> Column:
    """The nearest of the first ``steps`` ancestors that the rule holds for; those ``skip`` holds for do not count."""
    start = F.struct(F.lit(-1).alias("found"), F.lit(steps).alias("left"))

    def step(at, n, s):
        met = F.struct(F.when(rule(n), at).otherwise(F.lit(-1)).alias("found"), (s["left"] - 1).alias("left"))
        return F.when((s["found"] >= 0) | (s["left"] == 0) | skip(n), s).otherwise(met)

    return _held(nodes, _climb(nodes, node, start, step)["found"])


def text_pieces(nodes: Column) -> Column:
    """Trimmed non-empty visible texts of a slice."""
    texts = F.transform(F.filter(nodes, lambda n: n["tag"] == TEXT), lambda n: strip(n["text"]))
    return F.filter(texts, lambda t: t != "")


def inner_text(nodes: Column, sep: str = "") -> Column:
    return F.array_join(text_pieces(nodes), sep)


def raw_text(nodes: Column) -> Column:
    """Visible text as it stands, nothing trimmed."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: n["tag"] == TEXT), lambda n: n["text"]), "")


def text_of(nodes: Column, node: Column, sep: str = "") -> Column:
    """Visible text of one element; null when there is no such element."""
    return bind(node, lambda n: F.when(n.isNotNull(), inner_text(subtree(nodes, n), sep)))
