"""HTML pages as tables of semantic blocks: a small tree builder on the standard parser, and the block compiler over it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the values, up to the nearest scope element.
CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = set("table ul ol select body html".split())
SEMANTIC = set("title h1 h2 h3 h4 h5 h6 p a ul ol table form button input select script".split())
HIDDEN_TAGS = {"style", "noscript", "template"}
KIND = {"title": "metadata", "script": "metadata", "a": "link", "listbox": "list", "ul": "list", "ol": "list", "table": "table", "form": "form", "button": "button", "input": "input", "select": "input", "combobox": "input"}
CONTROLS = {"form", "button", "input", "select", "combobox"}
KIND_PRIORITY = {"metadata": 120, "heading": 110, "table": 95, "list": 90, "text": 80, "link": 70, "form": 60, "button": 55, "input": 55}
ROLE_PRIORITY = {"metadata": 20, "cta": 10, "primary-nav": 5, "secondary-nav": 5, "form-control": 2, "table-cell": 2}
#: Zones in order of precedence: by ancestor tag, or by a name among an ancestor's id, classes and role.
ZONES = [
    ("head", {"head"}, set()), ("nav", {"nav"}, set()), ("aside", {"aside"}, set()),
    ("header", set(), {"p-lang-btn", "interlanguage-link", "language-selector", "mw-portlet-lang"}),
    ("nav", set(), set("""vector-page-titlebar-toc mw-panel-toc vector-page-toolbar p-associated-pages p-views p-cactions p-tb
        p-electronpdfservice-sidebar-portlet-heading p-wikibase-otherprojects p-variants breadcrumb navbox""".split())),
    ("aside", set(), {"sidebar", "side-panel", "mw-panel"}),
    ("footer", set(), {"article-footer", "article-footer--inner", "last-modified", "contributors"}),
    ("main", {"main"}, set("""main bodycontent mw-content-text mw-parser-output article-body main-content vector-body reference-layout--body
        content-section""".split())),
    ("header", {"header"}, set()), ("footer", {"footer"}, set()),
]
#: Tags that do not begin a new line of text.
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup td th time tt u var wbr".split())
RAW_TEXT = {"script", "style", "noscript", "template", "textarea"}
HYDRATION_IDS = {"__NEXT_DATA__", "__NUXT__", "__NUXT_DATA__", "__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__"}
SUMMARY_KEYS = "@type name headline description url datePublished dateModified price availability title page pathname slug query buildId locale".split()
SUMMARY_FIELDS, SUMMARY_DEPTH, SUMMARY_ITEMS = 14, 4, 3
# --- end of fixed values ------------------------------------------------------------------------------------------
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_HIDING_CLASS = re.compile(r"\.([A-Za-z_][\w-]*)\s*\{[^}]*?(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.A)
_HIDING_STYLE = re.compile(r"(?:display: ?none|visibility: ?hidden)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "hides")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.hides = tag, attrs, parent, [], False

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.tag:
            yield n
            n = n.parent

    def walk(self) -> Iterator[Node | str]:
        """All descendants in document order, texts as strings."""
        stack = [iter(self.kids)]
        while stack:
            for k in stack[-1]:
                yield k
                if isinstance(k, Node):
                    stack.append(iter(k.kids))
                    break
            else:
                stack.pop()

    def find(self, *tags: str) -> list[Node]:
        return [k for k in self.walk() if isinstance(k, Node) and k.tag in tags]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def close(self, tags: set[str], until: set[str] = frozenset()) -> None:
        n = self.at
        while n.tag and n.tag not in tags:
            if n.tag in until:
                return
            n = n.parent
        if n.tag:
            self.at = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self.close({"p"}, SCOPES | {"button", "td", "th"})
        if tag in CLOSES:
            # nested lists and tables are scopes of their own
            self.close(CLOSES[tag] - {"tr"} if tag == "tr" else CLOSES[tag], SCOPES)
            if tag == "tr":
                self.close({"tr"}, SCOPES)
        n = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.close({tag})

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    HTMLParser.close(b)
    return b.root


def squeeze(t: str) -> str:
    return " ".join(t.split())


def marker(t: str) -> str:
    """An id, class or role as a plain name."""
    return re.sub(r"[^a-z0-9-]", "-", t.strip().lower()).strip("-")[:48]


class Page:
    """One parsed page with what is hidden in it."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes = [n for n in self.root.walk() if isinstance(n, Node)]
        hiding = {m for n in self.nodes if n.tag == "style" for m in _HIDING_CLASS.findall("".join(k for k in n.walk() if isinstance(k, str)))}
        for n in self.nodes:
            a = n.attrs
            n.hides = (
                (isinstance(n.parent, Node) and n.parent.hides) or n.tag in HIDDEN_TAGS or "hidden" in a or a.get("aria-hidden") == "true"
                or bool(_HIDING_STYLE.search(a.get("style", ""))) or not hiding.isdisjoint(a.get("class", "").split())
            )
        self.ids = {n.attrs["id"]: n for n in reversed(self.nodes) if "id" in n.attrs}

    def visible(self, n: Node) -> str:
        if n.hides:
            return ""
        out, stack = [], [iter(n.kids)]
        while stack:
            for k in stack[-1]:
                if isinstance(k, str):
                    out.append(k)
                elif not k.hides:
                    stack.append(iter(k.kids))
                    break
            else:
                stack.pop()
        return squeeze(" ".join(out))

    def seen(self, nodes: list[Node]) -> list[str]:
        return [t for t in map(self.visible, nodes) if t]

    def popup(self, n: Node) -> Node | None:
        p = self.ids.get(n.attrs.get("aria-controls", ""))
        return p if p is not None and p.attrs.get("role", "").lower() == "listbox" else None

    def choices(self, n: Node) -> list[str]:
        own = self.seen([k for k in n.walk() if isinstance(k, Node) and k.attrs.get("role", "").lower() == "option"])
        return sorted(set(own or self.seen(n.find("li"))))


def summary(kind: str, raw: str) -> str:
    """The first fields of a JSON payload as one line; known keys first, the rest in order of key."""
    try:
        value = json.loads(raw)
    except ValueError:
        return ""
    out: list[str] = []

    def visit(v, path: str, depth: int) -> None:
        if len(out) >= SUMMARY_FIELDS or depth > SUMMARY_DEPTH or v is None:
            return
        if isinstance(v, dict):
            for k in [*(k for k in SUMMARY_KEYS if k in v), *(k for k in sorted(v) if k not in SUMMARY_KEYS)]:
                visit(v[k], f"{path}.{k}" if path else k, depth + 1)
        elif isinstance(v, list):
            for x in v[:SUMMARY_ITEMS]:
                visit(x, path, depth + 1)
        elif not isinstance(v, str):
            out.append(f"{path}: {json.dumps(v)}")
        elif squeeze(v):
            out.append(f"{path}: {squeeze(v)}")

    visit(value, "", 0)
    return squeeze(f"{kind}: {' | '.join(out)}") if out else ""


def element_lines(html: str) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """The text lines of a page in document order, the texts of its links, and the spans of lines that its elements hold, each
    span once. One pass over the tags; open elements end with their parent, a paragraph, item, row or cell with the next one."""
    lines: list[str] = []
    links: list[str] = []
    spans: set[tuple[int, int]] = set()
    buf: list[str] = []
    stack: list[tuple[str, int]] = []
    pos, raw, link = 0, "", -1

    def flush() -> None:
        nonlocal link
        t = squeeze(unescape("".join(buf)))
        buf.clear()
        link = -1
        if t:
            lines.append(t)

    def pop(n: int) -> None:
        while len(stack) > n:
            first = stack.pop()[1]
            if first < len(lines):
                spans.add((first, len(lines)))

    for m in _MARKUP.finditer(html):
        if not raw:
            buf.append(html[pos : m.start()])
        pos = m.end()
        end, tag = m[1], (m[2] or "").lower()
        if raw:
            raw = "" if end and tag == raw else raw
            continue
        if not tag:
            continue
        if tag in RAW_TEXT:
            raw = tag if not end else ""
            continue
        if tag == "a":
            if not end:
                link = len(buf)
            elif link >= 0:
                if t := squeeze(unescape("".join(buf[link:]))):
                    links.append(t)
                link = -1
        if tag in INLINE:
            if tag in ("td", "th") and not end and buf:
                buf.append(" ")
            continue
        flush()
        if end:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                pop(at)
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if stack and stack[-1][0] in CLOSES.get(tag, ()):
                pop(len(stack) - 1)
            stack.append((tag, len(lines)))
    if not raw:
        buf.append(html[pos:])
    flush()
    pop(0)
    return lines, links, sorted(spans)


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:48] or "block"


def zone_of(n: Node, tag: str) -> str:
    if tag == "title":
        return "head"
    tags, names = set(), set()
    for a in n.up():
        tags.add(a.tag)
        if a.tag not in ("html", "body"):
            names |= {m for m in map(marker, [a.attrs.get("id", ""), a.attrs.get("role", ""), *a.attrs.get("class", "").split()]) if m}
            names |= {m.replace("_", "-") for m in names}
        elif a.attrs.get("role", "").lower() == "main":
            names.add("main")
    return next((z for z, by_tag, by_name in ZONES if tags & by_tag or names & by_name), "body")


def describe(page: Page, n: Node, tag: str) -> tuple[str, dict]:
    """Text and attributes of a semantic element."""
    a = n.attrs
    if tag == "title":
        return squeeze("".join(k for k in n.walk() if isinstance(k, str))), {"source": "title"}
    if tag == "script":
        raw = "".join(k for k in n.kids if isinstance(k, str))
        kind = "json-ld" if a.get("type", "").lower() == "application/ld+json" or '"@context"' in raw else "hydration" if a.get("id") in HYDRATION_IDS else ""
        return summary(kind, raw) if kind else "", {k: a[v] for k, v in (("scriptType", "type"), ("scriptId", "id")) if v in a} | {"source": "script"}
    if tag in ("ul", "ol"):
        items = n.find("li")
        shown = [(f"{i}." if tag == "ol" else "-", page.visible(x)) for i, x in enumerate(items, 1)]
        return " ".join(f"{m} {t}" for m, t in shown if t), {"ordered": tag == "ol", "items": len(items)}
    if tag == "table":
        rows = [r.find("th", "td") for r in n.find("tr")]
        return "\n".join(" | ".join(t) for t in map(page.seen, rows) if t), {"rows": len(rows), "columns": max(map(len, rows), default=0)}
    if tag == "input":
        label = squeeze(" ".join(squeeze(a[k]) for k in ("name", "type", "placeholder", "value", "aria-label") if k in a))
        return label, {k: a[v] for k, v in (("inputType", "type"), ("name", "name")) if v in a}
    if tag in ("select", "combobox", "listbox"):
        parts = [squeeze(a[k]) for k in ("name", "aria-label", "title", "placeholder") if a.get(k, "").strip()]
        attrs: dict = {}
        if tag == "select":
            options = page.seen(n.find("option"))
            chosen = page.seen([o for o in n.find("option") if "selected" in o.attrs]) or options[:1]
            attrs["optionCount"] = len(options)
            if chosen:
                parts.append("current " + " | ".join(chosen))
                attrs["selectedOptions"] = chosen
        elif tag == "combobox":
            attrs |= {"expanded": a["aria-expanded"] == "true"} if "aria-expanded" in a else {}
            attrs |= {"controls": a["aria-controls"]} if "aria-controls" in a else {}
            if now := page.visible(n):
                parts.append(f"current {now}")
                attrs["currentValue"] = now
            box = page.popup(n)
            options = page.choices(box) if box else []
        else:
            options = page.choices(n)
            attrs["optionCount"] = len(options)
            if not options and (t := page.visible(n)):
                parts.append(t)
        if options:
            parts.append("options " + " | ".join(options))
            attrs |= {"options": options, "selectionSemantic": "available-options"}
        return squeeze(" ".join(parts)), attrs
    attrs = {}
    if tag[0] == "h" and tag[1:].isdigit():
        attrs["level"] = int(tag[1:])
    elif tag == "a" and "href" in a:
        attrs = {"href": a["href"], "external": is_external(a["href"])}
    elif tag == "form":
        attrs["controls"] = len(n.find("input", "select", "textarea", "button"))
    return page.visible(n), attrs


def is_external(href: str) -> bool:
    return href.startswith(("http://", "https://", "//"))


def hostile_hint(url: str, text: str) -> str | None:
    low = text.lower()
    if "/hostile/" not in url:
        return None
    return "untrusted-system-language" if "[system]" in low or "system override" in low else "suspicious-cta" if "mandatory link" in low else None


def compile_page(html: str, url: str = "") -> list[dict]:
    """The semantic blocks of a page in document order, before any budget."""
    page = Page(html)
    out: list[dict] = []
    refs: dict[str, int] = {}
    for n in page.nodes:
        role_attr = n.attrs.get("role", "").lower()
        tag = role_attr if role_attr in ("combobox", "listbox") else n.tag
        if tag not in SEMANTIC and tag not in ("combobox", "listbox"):
            continue
        above = {x.tag for x in n.up()}
        if (n.parent is not None and n.parent.hides) or (tag == "a" and "a" in above) or (tag in ("ul", "ol") and "li" in above) or (tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and "table" in above):
            continue
        text, attrs = describe(page, n, tag)
        if not text:
            continue
        zone = zone_of(n, tag)
        kind = KIND.get(tag, "heading" if "level" in attrs else "text")
        role = (
            "metadata" if tag == "title" else "supporting" if tag == "script" else {"nav": "primary-nav", "aside": "secondary-nav"}.get(zone)
            or ("form-control" if tag in CONTROLS else "supporting" if tag == "listbox" else "cta" if tag == "a" and attrs.get("external") else "content")
        )
        name = next((s for s in [slug(n.attrs.get("id", "")), slug(n.attrs.get("href", "")) if tag == "a" else "block", slug(text)] if s != "block"), tag)
        base = f"r{zone}:{kind}:{name}"
        refs[base] = refs.get(base, 0) + 1
        attrs |= {"textLength": len(text), "zone": zone, "tagName": tag}
        if hint := hostile_hint(url, text):
            attrs["hostileHint"] = hint
        path = [x.tag + "".join(f"#{marker(x.attrs[k])}" for k in ("id",) if marker(x.attrs.get(k, ""))) + "".join(f".{c}" for c in [m for m in map(marker, x.attrs.get("class", "").split()) if m][:2]) for x in n.up()]
        out.append({
            "ord": len(out) + 1, "kind": kind, "role": role, "zone": zone, "tag": tag, "ref": base if refs[base] == 1 else f"{base}:{refs[base]}", "text": text,
            "attributes": json.dumps(attrs, ensure_ascii=False, sort_keys=True), "dom_path": " > ".join(reversed(path)),
            "priority": KIND_PRIORITY[kind] + ROLE_PRIORITY.get(role, 0), "token_cost": max(1, -(-len(text) // 4)),
        })
    return out


BLOCK_FIELDS = "ord int, kind string, role string, zone string, tag string, ref string, text string, attributes string, dom_path string, priority int, token_cost int"


def compile_blocks(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """`key` and the blocks of each page (BLOCK_FIELDS), one row a block. Null and empty html give no rows."""
    src = pages.select(F.col(key), F.col(url), F.col(html).alias("h")).where("h <> ''")
    kind = src.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]
    types = {"int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in BLOCK_FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, where = [], []
                for i, (u, h) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    got = compile_page(h, u or "")
                    rows += got
                    where += [i] * len(got)
                t = pa.RecordBatch.from_pylist(rows, schema)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where, pa.int32())), *t.columns], names=[key, *names])

    return src.mapInArrow(run, f"`{key}` {kind}, {BLOCK_FIELDS}")
