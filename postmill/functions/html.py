"""Pages as columns (X1-X4): an Arrow UDF flattens the markup and finds the selector matches.

The UDF is the only Python step. It returns a page's text once, in document order, its
elements and text runs as ranges of that text, and for each selector the numbers of the
matching elements, so its output is linear in the page. Fall-backs, defaults and clean-up
are expressions over that.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import SPACES

# The helper travels with the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INTS = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]
PAGE_TYPE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "els",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("idx", T.IntegerType()),
                        T.StructField("tag", T.StringType()),
                        T.StructField("href", T.StringType()),
                        T.StructField("content", T.StringType()),
                        *_INTS("parent", "last", "start", "stop"),
                    ]
                )
            ),
        ),
        T.StructField("runs", T.ArrayType(T.StructType(_INTS("owner", "start", "stop")))),
        T.StructField("hits", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    ]
)
_ARROW_INTS = lambda *names: [(n, pa.int32()) for n in names]
_ARROW = pa.struct(
    [
        ("text", pa.string()),
        (
            "els",
            pa.list_(
                pa.struct(
                    [
                        ("idx", pa.int32()),
                        ("tag", pa.string()),
                        ("href", pa.string()),
                        ("content", pa.string()),
                        *_ARROW_INTS("parent", "last", "start", "stop"),
                    ]
                )
            ),
        ),
        ("runs", pa.list_(pa.struct(_ARROW_INTS("owner", "start", "stop")))),
        ("hits", pa.map_(pa.string(), pa.list_(pa.int32()))),
    ]
)

#: Elements and runs (and 64 characters of markup each) that a task holds as Python objects at a time.
HELD_PARTS = 20_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("html head title meta link script style base noscript".split())
_SILENT = frozenset(("script", "style"))
_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
# Start tags that end an open element of the listed tags, and the containers that shield it.
_CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    **{tag: (("p",), ("button", "td", "th", "table")) for tag in _BLOCK},
}


class _Flattener(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.els: list[dict] = []
        self.runs: list[dict] = []
        self.text: list[str] = []
        self.size = 0
        self.stack: list[int] = []
        self.body = False
        self._open("html", {})

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        at = len(self.els)
        self.els.append(
            {
                "idx": at,
                "tag": tag,
                "classes": attrs.get("class", "").split(),
                "attrs": attrs,
                "href": attrs.get("href"),
                "content": attrs.get("content"),
                "parent": self.stack[-1] if self.stack else -1,
                "last": at,
                "start": self.size,
                "stop": self.size,
            }
        )
        self.stack.append(at)

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            el = self.els[self.stack.pop()]
            el["last"], el["stop"] = len(self.els) - 1, self.size

    def _tag(self, depth: int) -> str:
        return self.els[self.stack[depth]]["tag"]

    def _need_body(self) -> None:
        if not self.body:
            self._close_to(1)
            self.body = True
            self._open("body", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag == "body":
            if not self.body:
                self._close_to(1)
                self.body = True
                self._open("body", {k: v or "" for k, v in attrs})
            return
        if tag not in _HEAD:
            self._need_body()
        closed, shields = _CLOSES.get(tag, ((), ()))
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self._tag(depth)
            if name in closed:
                self._close_to(depth)
                break
            if name in shields:
                break
        self._open(tag, {k: v or "" for k, v in attrs})
        if tag in _VOID:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self._tag(depth) == tag:
                if tag not in ("body", "html"):
                    self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if self._tag(-1) in _SILENT:
            return
        if len(self.stack) == 1:
            if not data.strip():
                return
            self._need_body()
        self.runs.append({"owner": self.stack[-1], "start": self.size, "stop": self.size + len(data)})
        self.text.append(data)
        self.size += len(data)

    def finish(self) -> _Flattener:
        self.close()
        self._need_body()
        self._close_to(0)
        self.flat = "".join(self.text)
        self.having: dict[tuple[str, str], list[dict]] = {}
        for e in self.els:
            names = [("tag", e["tag"]), *(("cls", c) for c in dict.fromkeys(e["classes"])), *(("attr", a) for a in e["attrs"])]
            for name in names:
                self.having.setdefault(name, []).append(e)
        return self


# The selector subset of the tables: tag, class, id, attribute tests, :contains, :has, child
# and descendant steps, comma groups.
_PART = re.compile(
    r"^(?P<tag>[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)['\"]?(?P<val>[^'\"\]]*)['\"]?)?\]"
    r"|:contains\(['\"](?P<has_text>[^'\"]*)['\"]\)|:has\((?P<has>[^)]*)\)"
)
_COMPARE = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith}

Test = Callable[[_Flattener, dict], bool]


def _compound(part: str) -> Test:
    """Test of one element against one selector step."""
    found = [m.groupdict() | {"all": m.group(0)} for m in _PART.finditer(part)]
    if not found or "".join(g["all"] for g in found) != part:
        raise ValueError(f"unsupported selector: {part}")
    inner = [_compound(g["has"]) for g in found if g["has"]]
    tests: list[Test] = []
    for g in found:
        if g["tag"]:
            tests.append(lambda p, e, v=g["tag"].lower(): e["tag"] == v)
        elif g["cls"]:
            tests.append(lambda p, e, v=g["cls"]: v in e["classes"])
        elif g["id"]:
            tests.append(lambda p, e, v=g["id"]: e["attrs"].get("id") == v)
        elif g["attr"] and not g["op"]:
            tests.append(lambda p, e, n=g["attr"]: n in e["attrs"])
        elif g["attr"]:
            tests.append(
                lambda p, e, n=g["attr"], v=g["val"], c=_COMPARE[g["op"]]: n in e["attrs"] and c(e["attrs"][n], v)
            )
        elif g["has_text"] is not None:
            tests.append(lambda p, e, v=g["has_text"]: v in p.flat[e["start"] : e["stop"]])
        else:
            test = inner.pop(0)
            tests.append(
                lambda p, e, t=test: any(t(p, p.els[i]) for i in range(e["idx"] + 1, e["last"] + 1))
            )
    return tests[0] if len(tests) == 1 else lambda p, e: all(t(p, e) for t in tests)


def _steps(selector: str) -> list[tuple[bool, Test]]:
    """(is a child step, test) from left to right."""
    parts = re.findall(r">|(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+", selector)
    return [(i > 0 and parts[i - 1] == ">", _compound(p)) for i, p in enumerate(parts) if p != ">"]


def _matches(page: _Flattener, e: dict, steps: list[tuple[bool, Test]]) -> bool:
    child, test = steps[-1]
    if not test(page, e):
        return False
    if len(steps) == 1:
        return True
    up = e["parent"]
    while up >= 0:
        outer = page.els[up]
        if _matches(page, outer, steps[:-1]):
            return True
        if child:
            return False
        up = outer["parent"]
    return False


def _needs(selector: str) -> tuple[str, str] | None:
    """A tag, class or attribute that the elements a selector matches have; None if it names none."""
    last = re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+", selector)[-1]
    named = _PART.match(last).groupdict()
    if named["tag"]:
        return "tag", named["tag"].lower()
    if named["cls"]:
        return "cls", named["cls"]
    return ("attr", named["attr"] or "id") if named["attr"] or named["id"] else None


def _group(selectors: str) -> Callable[[_Flattener], list[int]]:
    listed = re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^,])+", selectors)
    alternatives = [(_steps(s), _needs(s)) for s in listed]

    def find(page: _Flattener) -> list[int]:
        found = {
            e["idx"]
            for steps, needs in alternatives
            for e in (page.els if needs is None else page.having.get(needs, ()))
            if _matches(page, e, steps)
        }
        return sorted(found)

    return find


def page_udf(selectors: Mapping[str, Iterable[str]]) -> Callable[[Column, Column], Column]:
    """UDF (html, group) -> page; the group names the selectors to look for."""
    keys = {group: tuple(dict.fromkeys(names)) for group, names in selectors.items()}
    for names in keys.values():  # refuse unsupported selectors here rather than in a task
        for name in names:
            _group(name)

    @F.arrow_udf(PAGE_TYPE)
    def flatten(html: pa.Array, group: pa.Array) -> pa.Array:
        finders: dict[str, list[tuple[str, Callable]]] = {}
        done, out, held = [pa.array([], type=_ARROW)], [], 0
        for text, name in zip(html, group):
            text, name = text.as_py(), name.as_py()
            if text is None:
                out.append(None)
                continue
            if name not in finders:
                finders[name] = [(k, _group(k)) for k in keys.get(name, ())]
            page = _Flattener()
            page.feed(text)
            page.finish()
            hits = [(k, found) for k, find in finders[name] if (found := find(page))]
            out.append({"text": page.flat, "els": page.els, "runs": page.runs, "hits": hits})
            # Python objects take many times the room of the arrays they become.
            held += len(page.els) + len(page.runs) + len(text) // 64
            if held > HELD_PARTS:
                done.append(pa.array(out, type=_ARROW))
                out, held = [], 0
        done.append(pa.array(out, type=_ARROW))
        return pa.concat_arrays(done)

    return flatten


# --- expressions over a page ---------------------------------------------------------------
#
# These build SQL text, for `F.expr`: a rule with nested lambdas is one call to the JVM, not hundreds.
# `page`, `card`, `selectors` and the like are SQL expressions too.

_depth = 0


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(texts: Iterable[str]) -> str:
    """An array of string literals."""
    return f"cast(array({', '.join(map(lit, texts))}) AS array<string>)"


def fn(body: Callable[[str], str]) -> str:
    """A SQL lambda; variables are named by nesting, so equal rules have equal text."""
    global _depth
    _depth += 1
    try:
        return f"x{_depth} -> {body(f'x{_depth}')}"
    finally:
        _depth -= 1


def bound(value: str, body: Callable[[str], str]) -> str:
    """`body` of a value that is computed once."""
    return f"get(transform(array({value}), {fn(body)}), 0)"


def mapped(values: str, body: Callable[[str], str]) -> str:
    return f"transform({values}, {fn(body)})"


def kept(values: str, test: Callable[[str], str]) -> str:
    return f"filter({values}, {fn(test)})"


def trimmed(text: str) -> str:
    return f"btrim({text}, {lit(SPACES)})"


def either(*texts: str) -> str:
    """The first text that is neither null nor empty; empty if none is."""
    return f"coalesce({', '.join(f'nullif({t}, {lit("")})' for t in texts)}, '')"


def hits(page: str, selector: str) -> str:
    """Numbers of the elements a selector (an expression) matches, in document order."""
    return f"coalesce(try_element_at({page}.hits, {selector}), cast(array() AS array<int>))"


def within(found: str, card: str | None) -> str:
    """Of the found elements those inside `card`."""
    return found if card is None else kept(found, lambda i: f"({i} > {card}.idx AND {i} <= {card}.last)")


def _span(page: str, part: str) -> str:
    return f"substring({page}.text, {part}.start + 1, {part}.stop - {part}.start)"


def element(page: str, idx: str) -> str:
    return f"get({page}.els, {idx})"


def text_of(page: str, idx: str) -> str:
    """All text inside an element."""
    return bound(element(page, idx), lambda e: _span(page, e))


def own_text_of(page: str, idx: str) -> str:
    """Text directly in an element, without that of its child elements."""
    runs = kept(f"{page}.runs", lambda r: f"{r}.owner = {idx}")
    return f"CASE WHEN {idx} IS NOT NULL THEN array_join({mapped(runs, lambda r: _span(page, r))}, '') END"


def first_of(values: str) -> str:
    """The first value that is neither null nor empty."""
    return f"get({kept(values, lambda v: f'({v} IS NOT NULL AND {v} <> {lit("")})')}, 0)"


def first_text(page: str, selectors: str, card: str | None = None) -> str:
    """Trimmed text of the first match of the first selector that has any; else empty."""
    one = lambda s: trimmed(text_of(page, f"get({within(hits(page, s), card)}, 0)"))
    return f"coalesce({first_of(mapped(selectors, one))}, '')"


def first_own_text(page: str, selectors: str) -> str:
    """As `first_text`, own text preferred and style-sheet debris refused."""

    def bare(raw: str) -> str:
        ruled = trimmed(f"regexp_replace({raw}, {lit(r'\{[^}]*\}')}, '')")
        return trimmed(f"regexp_replace({ruled}, {lit(r'@media[^}]*\}')}, '')")

    def judged(t: str) -> str:
        clean = f"NOT contains({t}.raw, '.css-') AND NOT {t}.bare RLIKE {lit('[{}]|@media')}"
        return f"CASE WHEN {clean} AND length({t}.bare) BETWEEN 1 AND 499 THEN {t}.bare END"

    def one(idx: str) -> str:
        raw = either(trimmed(own_text_of(page, idx)), trimmed(text_of(page, idx)))
        both = bound(raw, lambda r: f"named_struct('raw', {r}, 'bare', {bare(r)})")
        return bound(both, judged)

    return f"coalesce({first_of(mapped(selectors, lambda s: bound(f'get({hits(page, s)}, 0)', one)))}, '')"


def texts_of(page: str, found: str) -> str:
    """Trimmed texts of the found elements."""
    return mapped(found, lambda i: trimmed(text_of(page, i)))


def all_texts(page: str, selectors: str) -> str:
    """All non-empty texts of the first selector that has any."""
    lists = mapped(selectors, lambda s: kept(texts_of(page, hits(page, s)), lambda t: f"{t} <> ''"))
    return f"coalesce(get({kept(lists, lambda a: f'size({a}) > 0')}, 0), cast(array() AS array<string>))"


def first_attr(page: str, selectors: str, attr: str, card: str | None = None) -> str:
    """Href or content of the first match of the first selector that has it; null if none."""
    one = lambda s: trimmed(f"{element(page, f'get({within(hits(page, s), card)}, 0)')}.{attr}")
    return first_of(mapped(selectors, one))


def joined_text(page: str, selector: str) -> str:
    """Texts of all matches one after the other, trimmed."""
    return trimmed(f"array_join({mapped(hits(page, selector), lambda i: text_of(page, i))}, '')")


def longest_text(page: str, start: str, containers: str) -> str:
    """The longest of `start` and the container texts, the first one on ties."""
    texts = mapped(containers, lambda s: joined_text(page, s))
    return f"aggregate({texts}, {start}, (best, t) -> CASE WHEN length(t) > length(best) THEN t ELSE best END)"


def text_without(page: str, outer: str, removed: str) -> str:
    """Text of the first `outer` element without that of the removed elements, trimmed."""

    def cut(b: str) -> str:
        inside = lambda r, e: f"({r}.owner >= {e}.idx AND {r}.owner <= {e}.last)"
        gone = lambda r: f"exists({b}.gone, {fn(lambda g: inside(r, g))})"
        runs = kept(f"{page}.runs", lambda r: f"({inside(r, f'{b}.outer')} AND NOT {gone(r)})")
        return f"array_join({mapped(runs, lambda r: _span(page, r))}, '')"

    gone = mapped(hits(page, removed), lambda i: element(page, i))
    whole = element(page, f"get({hits(page, outer)}, 0)")
    return trimmed(bound(f"named_struct('outer', {whole}, 'gone', {gone})", cut))
