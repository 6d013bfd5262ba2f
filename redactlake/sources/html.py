"""Controls, texts and regions of raw pages, parsed in the executors.

A page is read into a tree without layout: what depends on rendered sizes (visible
areas, distances, circles) is left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

# Roles by tag, what is a control, limits of a snapshot, and names of sensitive inputs.
ROLES = {"a": "link", "button": "button", "summary": "button", "select": "select", "textarea": "textbox"}
MOST_ELEMENTS, MOST_TEXT, MOST_AFFORDANCES, MOST_REGIONS, MOST_NODES = 80, 6000, 120, 200, 8000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "title", "head"}
SECRET_NAMES = ("card", "credit", "cvv", "cvc", "aadhaar", "pan", "ssn", "passport", "otp", "pin", "apikey", "api_key", "secret", "token")
SECRET_COMPLETION = ("current-password", "new-password", "cc-number", "cc-exp", "cc-csc", "one-time-code")
ENTRY_ROLES = {"textbox", "searchbox", "combobox", "password"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "nth")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.nth = tag, attrs, parent, [], 0

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Node):
                todo.extend(reversed(n.children))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SILENT:
                todo.extend(reversed(n.children))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        node.nth = len(self.at.children)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    p = _Tree()
    p.feed(html or "")
    p.close()
    return p.root


def nodes(root: Node) -> list[Node]:
    return [n for n in root.walk() if isinstance(n, Node)]


def role_of(n: Node) -> str:
    if n.attrs.get("role"):
        return n.attrs["role"]
    if n.tag == "input":
        kind = n.attrs.get("type", "text").lower()
        return kind if kind in ("checkbox", "radio", "submit", "password") else "textbox"
    return ROLES.get(n.tag) or ("textbox" if "contenteditable" in n.attrs else n.tag)


def is_control(n: Node) -> bool:
    return (n.tag in ROLES or n.tag == "input" or "contenteditable" in n.attrs or n.attrs.get("role") in ENTRY_ROLES | {"button", "link", "checkbox", "tab", "menuitem"}) and n.attrs.get("type") != "hidden"


def label_for(n: Node, by_for: dict[str, Node]) -> Node | None:
    """The label that names n by its id, else the one around it."""
    found, up = by_for.get(n.attrs.get("id", "")), n.parent
    while found is None and up is not None:
        found, up = (up if up.tag == "label" else None), up.parent
    return found


def layout_label(n: Node) -> str:
    """Text of the element before n (40 characters at most), else of the nearest of three ancestors with some (60 at most)."""
    before = [c for c in n.parent.children[: n.parent.children.index(n)] if isinstance(c, Node)] if n.parent else []
    if before and (t := before[-1].text()) and len(t) <= 40:
        return t
    up = n.parent
    for _ in range(3):
        if up is None:
            break
        if (t := up.text()) and len(t) <= 60:
            return t
        up = up.parent
    return ""


def accessible_name(n: Node, by_id: dict[str, Node], by_for: dict[str, Node]) -> str:
    clean = lambda v: " ".join((v or "").split())
    named = clean(" ".join(by_id[i].text() for i in n.attrs.get("aria-labelledby", "").split() if i in by_id))
    entry = n.tag in ("input", "textarea", "select") or "contenteditable" in n.attrs or n.attrs.get("role") in ENTRY_ROLES
    label = label_for(n, by_for) if n.tag in ("input", "textarea") else None
    tries = (named, clean(n.attrs.get("aria-label")), label.text() if label else "", clean(n.attrs.get("placeholder")) if n.tag in ("input", "textarea") else "", clean(n.attrs.get("alt")) if n.tag == "img" else "", n.text(), clean(n.attrs.get("title") or n.attrs.get("name")))
    return next((t for t in tries if t), layout_label(n) if entry else "")


def value_of(n: Node) -> str | None:
    kind = n.attrs.get("type", "text").lower()
    if n.tag == "input":
        if kind in ("checkbox", "radio"):
            return None
        own = n.attrs.get("value", "")
        return ("••••••" if own else "") if kind == "password" else " ".join(own.split())
    if n.tag == "textarea":
        return n.text()
    if n.tag == "select":
        options = [c for c in nodes(n) if c.tag == "option"]
        chosen = next((c for c in options if "selected" in c.attrs), options[0] if options else None)
        return chosen.text() if chosen else ""
    return None


def attributes_of(n: Node) -> dict[str, str]:
    out, kind = {}, n.attrs.get("type", "text").lower()
    if n.tag == "input":
        if kind in ("checkbox", "radio"):
            out["checked"] = "true" if "checked" in n.attrs else "false"
        if "required" in n.attrs:
            out["required"] = "true"
        out["inputType"] = kind
    if "disabled" in n.attrs:
        out["disabled"] = "true"
    for key, name in (("expanded", "aria-expanded"), ("selected", "aria-selected")):
        if n.attrs.get(name):
            out[key] = n.attrs[name]
    if n.tag == "a" and n.attrs.get("href"):
        try:
            url = urlsplit(n.attrs["href"])
            if url.netloc:
                out["href"] = url.netloc + ("" if url.path in ("", "/") else url.path[:40])
        except ValueError:
            pass
    return out


def main_text(root: Node) -> str:
    """Text of the main role or element, else the article, else the body; not cut."""
    every = nodes(root)
    for fits in (lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.tag == "body"):
        if (found := next((n for n in every if fits(n)), None)) is not None and (t := found.text()):
            return t
    return root.text()


def controls(html: str | None) -> list[dict]:
    """All controls of a page in document order."""
    root = tree(html)
    every = nodes(root)
    by_id = {n.attrs["id"]: n for n in reversed(every) if n.attrs.get("id")}
    by_for = {n.attrs["for"]: n for n in reversed(every) if n.tag == "label" and n.attrs.get("for")}
    return [{"id": i, "role": role_of(n), "name": accessible_name(n, by_id, by_for), "value": value_of(n), "attrs": sorted(attributes_of(n).items()), "layout": layout_label(n)} for i, n in enumerate((n for n in every if is_control(n)), 1)]


def parsed(html: str | None) -> tuple[str, str, list[dict]]:
    """Title, main text and first controls of a page, as a snapshot has them: both are capped."""
    root = tree(html)
    title = next((" ".join("".join(c for c in n.children if isinstance(c, str)).split()) for n in nodes(root) if n.tag == "title"), "")
    text = main_text(root)
    found = [{k: c[k] for k in ("id", "role", "name", "value", "attrs")} for c in controls(html)[:MOST_ELEMENTS]]
    return title, text if len(text) <= MOST_TEXT else text[:MOST_TEXT] + " […]", found


def sensitive(html: str | None) -> list[dict]:
    """Regions of a page by element: inputs named as secrets and their labels, other inputs but searches, contact chips and portraits; an element once, by the first family that has it."""
    root = tree(html)
    every = nodes(root)
    by_for = {n.attrs["for"]: n for n in reversed(every) if n.tag == "label" and n.attrs.get("for")}
    seen, out = set(), []

    def add(n, kind, label, value=None):
        if id(n) not in seen:
            seen.add(id(n))
            out.append({"nth": len(out), "kind": kind, "label": label, "value": value or None})

    for n in every:
        name = n.attrs.get("name", "").lower()
        if n.tag == "input" and (n.attrs.get("type") == "password" or n.attrs.get("autocomplete") in SECRET_COMPLETION or any(s in name for s in SECRET_NAMES)):
            kind = "password" if n.attrs.get("type") == "password" else "credit_card" if "cc-" in n.attrs.get("autocomplete", "") else "otp" if "one-time" in n.attrs.get("autocomplete", "") else "id_number" if re.search("aadhaar|ssn|passport", name) else "pan_card" if "pan" in name else "cvv" if re.search("cvv|cvc", name) else "api_key" if re.search("apikey|api_key|secret|token", name) else "credential"
            label = label_for(n, by_for)
            add(n, kind, (label.text() if label else "") or n.attrs.get("name") or kind, n.attrs.get("value"))
            if label is not None:
                add(label, "credential_label", f"Label for {kind}")
    for n in every:
        name, hint = n.attrs.get("name", "").lower(), n.attrs.get("placeholder", "").lower()
        if (n.tag in ("input", "textarea") and n.attrs.get("type", "text") not in ("hidden", "submit", "button", "checkbox", "radio")) and not ("search" in name or name == "q" or "search" in hint or n.attrs.get("role") == "searchbox"):
            label = label_for(n, by_for)
            add(n, "input_field", (label.text() if label else "") or n.attrs.get("name") or "input_field", n.attrs.get("value"))
    for n in every:
        if n.attrs.get("email") or "@" in n.attrs.get("data-hovercard-id", ""):
            add(n, "email_text", "Sender/contact", n.attrs.get("email") or n.attrs.get("data-hovercard-id") or n.text())
    for n in every:
        if n.tag == "img" and (re.search("avatar|profile|photo", n.attrs.get("src", "")) or re.search("(?i)avatar|profile", n.attrs.get("alt", "") + " " + n.attrs.get("class", ""))):
            add(n, "face", "Profile/avatar image")
    return out


def texts(html: str | None) -> list[str]:
    """Text nodes in document order, trimmed, not empty."""
    out, todo = [], [tree(html)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                out.append(n.strip())
        elif n.tag not in SILENT:
            todo.extend(reversed(n.children))
    return out


def affordances(html: str | None) -> list[dict]:
    """The first names of controls: placeholders, labels, alternative texts, tooltips and button values."""
    every = nodes(tree(html))
    rows = [
        *(("placeholder", n.attrs.get("placeholder")) for n in every if n.tag in ("input", "textarea")),
        *(("aria-label", n.attrs.get("aria-label")) for n in every if not (n.tag == "input" and n.attrs.get("aria-label") == n.attrs.get("placeholder"))),
        *(("alt", n.attrs.get("alt")) for n in every if n.tag == "img"), *(("tooltip", n.attrs.get("title")) for n in every),
        *(("button", n.attrs.get("value")) for n in every if n.tag == "input" and n.attrs.get("type") in ("submit", "button")),
    ]
    found = [(s, v.strip()[:200]) for s, v in rows if v and len(v.strip()) >= 2]
    return [{"nth": i, "label": v, "source": s} for i, (s, v) in enumerate(found[:MOST_AFFORDANCES])]


def per_page(pages: DataFrame, make, item: str, arrow: pa.DataType, name: str) -> DataFrame:
    """page_id and an array of what make(html) gives."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(x) for x in b.column(1).to_pylist()], pa.list_(arrow))], names=["page_id", name])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, {name} array<{item}>")


_CONTROL = "struct<id: int, role: string, name: string, value: string, attrs: map<string, string>, layout: string>"
_CONTROL_ARROW = pa.struct([("id", pa.int32()), ("role", pa.string()), ("name", pa.string()), ("value", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("layout", pa.string())])


def all_controls(pages: DataFrame) -> DataFrame:
    return per_page(pages, controls, _CONTROL, _CONTROL_ARROW, "controls")


def sensitive_regions(pages: DataFrame) -> DataFrame:
    return per_page(pages, sensitive, "struct<nth: int, kind: string, label: string, value: string>", pa.struct([("nth", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("value", pa.string())]), "regions")


def text_nodes(pages: DataFrame) -> DataFrame:
    return per_page(pages, texts, "string", pa.string(), "texts")


def affordance_runs(pages: DataFrame) -> DataFrame:
    return per_page(pages, affordances, "struct<nth: int, label: string, source: string>", pa.struct([("nth", pa.int32()), ("label", pa.string()), ("source", pa.string())]), "affordances")


def snapshots(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text and elements of pages (page_id, url, html)."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("role", pa.string()), ("name", pa.string()), ("value", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))

    def run(batches):
        for b in batches:
            rows = [parsed(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)], names=["page_id", "url", "title", "text", "elements"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, elements array<struct<id: int, role: string, name: string, value: string, attrs: map<string, string>>>")
