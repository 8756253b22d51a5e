"""Scholarly web pages as rows: blocks, authors with their affiliations, figures, cells, a bibliography, and
links that find what they point at.

A page is one row and is read once, inside an Arrow batch; `papers` gives a row a page with what was found in
arrays, and the other functions take them apart. What a link means is found within its page's row, from the
arrays of links and anchors: their exploded rows are many, though their table is small enough to be broadcast.

Null and empty pages give a rejected paper without blocks. Broken markup is read as far as the parser gets;
depth is no limit, as nothing here recurses. Of anchors of one name on a page the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

from marlstone.session import load
from marlstone.sources.html import Node, table_cells, tree

# Tags and classes that are no text of a paper, classes of its head, classes that name a kind,
# labels of captions, mail addresses, numbers of preprints.
NOISE = ("script", "style", "nav", "footer", "aside", "dialog", "form", "button", "noscript")
NOISE_CLASSES = ("ltx_page_header", "ltx_page_footer", "ltx_page_logo", "ltx_rdf", "ltx_pagination", "ltx_role_versionnotice", "ltx_ERROR", "ds-announcement")
HEAD_CLASSES = ("ltx_authors", "ltx_author_notes", "ltx_role_author", "ltx_license", "ltx_copyright")
KINDS = (("theorem", "theorem"), ("proof", "proof"), ("algorithm", "algorithm"), ("listing", "code"), ("lstlisting", "code"), ("appendix", "appendix"), ("footnote", "footnote"))
FIGURE_LABEL = re.compile(r"(?:Figure|Fig\.?|图)\s*([A-Za-z]?\d+(?:[.:-]\d+)*)", re.I)
TABLE_LABEL = re.compile(r"(?:Table|表)\s*([A-Za-z]?\d+(?:[.:-]\d+)*)", re.I)
CODE_LABEL = re.compile(r"^(?:Code|Listing)\s*\d+\b", re.I)
EMAIL = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", re.I)
PREPRINT = re.compile(r"(?:arXiv:)?(\d{4}\.\d{4,5})(?:v\d+)?", re.I)
#: The meta tags that hold a field, the first that is there counts.
META = {
    "title": ("citation_title", "dc.title", "og:title"), "abstract": ("citation_abstract", "dc.description"), "published": ("citation_publication_date", "article:published_time"),
    "venue": ("citation_journal_title", "citation_conference_title"), "doi": ("citation_doi", "dc.identifier"), "license": ("citation_license", "dc.rights"),
}
MEDIA = ("img", "svg", "object", "embed")
_H = ("h1", "h2", "h3", "h4", "h5", "h6")
_PLAIN = {"p": "paragraph", "blockquote": "quote", "pre": "code"}
#: Tags whose text may not be what stands below them.
_UNSEEN = ("math", "annotation", "annotation-xml")

_TEXT, _INT = pa.string(), pa.int32()
_TEXTS = pa.list_(_TEXT)
_rows = lambda **fields: pa.list_(pa.struct(list(fields.items())))
FOUND = pa.schema({
    "page": pa.int64(), "title": _TEXT, "abstract": _TEXT, "published": _TEXT, "venue": _TEXT, "doi": _TEXT, "preprint": _TEXT, "license": _TEXT, "language": _TEXT, "keywords": _TEXTS, "status": _TEXT, "reasons": _TEXTS,
    "authors": _rows(name=_TEXT, affiliations=_TEXTS, emails=_TEXTS, notes=_TEXTS),
    "blocks": _rows(kind=_TEXT, parent=_INT, level=_INT, label=_TEXT, text=_TEXT),
    "cells": _rows(block=_INT, row=_INT, col=_INT, rowspan=_INT, colspan=_INT, role=_TEXT, text=_TEXT),
    "panels": _rows(block=_INT, place=_INT, label=_TEXT, src=_TEXT, state=_TEXT),
    "links": _rows(block=_INT, kind=_TEXT, target=_TEXT, label=_TEXT),
    "anchors": _rows(name=_TEXT, block=_INT, entry=pa.bool_()),
})
#: Fields that come from a page's head and its marked names, without its blocks.
ABOUT = ("title", "abstract", "published", "venue", "doi", "preprint", "license", "language", "keywords", "authors")
_NAMES = {f: FOUND.field(f).type.value_type.names for f in ("cells", "panels", "links", "anchors")}
#: What a link leads to.
_END = pa.struct({"status": _TEXT, "to_block": _INT, "to_entry": pa.bool_()})
#: Pages whose rows go on together.
CHUNK = 32


def _named(node: Node, *parts: str) -> bool:
    return "class" in node.attrs and _has(node.attrs["class"].lower(), parts)


def _has(names: str, parts: tuple[str, ...]) -> bool:
    for p in parts:
        if p in names:
            return True
    return False


def _text(node: Node, skip: tuple[str, ...] = ()) -> str:
    """A node's text, white space collapsed; a formula as its source, where the page has that."""
    if len(node.kids) == 1 and isinstance(node.kids[0], str) and node.tag not in _UNSEEN and node.tag not in skip:
        return " ".join(node.kids[0].split())
    out: list[str] = []
    held: list[Node | str] = [node]
    while held:
        x = held.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "math" and x.attrs.get("alttext", "").strip():
            out.append(x.attrs["alttext"].strip())
        elif x.tag not in skip and x.tag not in ("annotation", "annotation-xml"):
            held += reversed(x.kids)
    return " ".join("".join(out).split())


def _figure_of(node: Node) -> Node | None:
    while (node := node.up) is not None:
        if node.tag == "figure":
            return node
    return None


def _caption(node: Node) -> Node | None:
    """A node's caption: its own child, else one below that no figure within it owns."""
    found = [n for n in node.below() if n.tag in ("figcaption", "caption")]
    return next((n for n in found if n.up is node), next((n for n in found if _figure_of(n) in (None, node)), None))


def _unique(values) -> list[str]:
    return [*dict.fromkeys(v for v in values if v)]


def _rights(text: str) -> bool:
    low = text.lower()
    return "permission to reproduce" in low and ("table" in low or "figure" in low)


class _Paper:
    """What one page holds. Blocks are found by a walk with a list of nodes still to see; every step either
    takes a node as blocks or puts its children on the list. Only the fields asked for are looked for."""

    def __init__(self, html: str, url: str):
        self.every: list[Node] = []
        self.root, self.url = tree(html, every=self.every), url
        self.classed = [(n, n.attrs["class"].lower()) for n in self.every if "class" in n.attrs]
        #: Whether a part of the page can be about rights: its text is part of the page's, unless something is unseen.
        self.rights = any(n.tag in _UNSEEN for n in self.every) or "permission to reproduce" in _text(self.root).lower()
        self.blocks: list[dict] = []
        self.cells: list[tuple] = []
        self.panels: list[tuple] = []
        self.reasons: list[str] = []
        self.of: dict[int, int] = {}
        self.open: list[tuple[int, int]] = []
        self.count = {"Image": 0, "Table": 0}

    def walk(self) -> None:
        todo = [next((n for n in self.every if n.tag in ("article", "main")), self.root)]
        while todo:
            node = todo.pop()
            todo += [k for k in reversed(self.take(node)) if isinstance(k, Node)]

    # Blocks

    def add(self, kind: str, text: str, node: Node, parent: int | None = None, level: int | None = None, label: str | None = None) -> int | None:
        if not text and kind not in ("figure", "table"):
            return None
        if parent is None and self.open:
            parent = self.open[-1][1]
        self.blocks.append({"kind": kind, "parent": parent, "level": level, "label": label, "text": text})
        self.of[id(node)] = number = len(self.blocks) - 1
        return number

    def kind(self, node: Node) -> str:
        """What a node is: a kind of block, `noise`, or `box` for what only holds others."""
        tag, names = node.tag, node.attrs.get("class", "")
        classes, low = names.split(), names.lower()
        if tag in NOISE or any(c in NOISE_CLASSES or c in HEAD_CLASSES for c in classes):
            return "noise"
        if self.rights and (tag == "p" or "ltx_para" in classes) and _rights(_text(node)):
            return "noise"
        marked = next((k for part, k in KINDS if part in low), None) if low else None
        if marked == "appendix":
            return "box"
        if marked in ("algorithm", "code"):
            return marked
        if tag in ("figure", "table"):
            return tag
        if "abstract" in low:
            return "abstract"
        return "heading" if tag in _H else marked or ("list" if tag in ("ul", "ol") else _PLAIN.get(tag, "box"))

    def take(self, node: Node) -> list:
        """Make a node's blocks; gives the nodes still to be seen in its place."""
        kind = self.kind(node)
        if kind == "box":
            return node.kids
        if kind in ("figure", "table", "heading", "list"):
            return getattr(self, kind)(node) or []
        if kind == "abstract":
            self.add(kind, re.sub(r"^Abstract\s*", "", _text(node, NOISE), flags=re.I).strip(), node)
        elif kind != "noise":
            plain = node.tag in _PLAIN and kind == _PLAIN[node.tag]
            number = self.add(kind, _text(node, () if plain else NOISE), node)
            if plain:
                self.formulas(node, number)
        return []

    def formulas(self, node: Node, parent: int | None) -> None:
        for math in (n for n in node.below() if n.tag == "math"):
            self.add("formula", " ".join(_text(math).split()), math, parent, label="display" if math.attrs.get("display") == "block" else None)

    def heading(self, node: Node) -> None:
        level, title = int(node.tag[1]), node.tag == "h1" and all(b["kind"] != "title" for b in self.blocks)
        number = self.add("title" if title else "heading", _text(node), node, self.above(level), level)
        if number is not None and not title:
            self.open = [o for o in self.open if o[0] < level] + [(level, number)]

    def above(self, level: int) -> int | None:
        """The heading that a heading of a level stands under; those of its level and below end with it."""
        self.open = [o for o in self.open if o[0] < level]
        return self.open[-1][1] if self.open else None

    def list(self, node: Node) -> list[Node]:
        number = self.add("list", _text(node), node, label="ordered" if node.tag == "ol" else None)
        for item in (k for k in node.kids if isinstance(k, Node) and k.tag == "li"):
            self.add("list_item", _text(item), item, number)
        return self.outermost(node, ("figure", "table"))

    def outermost(self, node: Node, tags: tuple[str, ...]) -> list[Node]:
        """The nodes of some tags below a node that are in no other such node."""
        out, held = [], [k for k in reversed(node.kids) if isinstance(k, Node)]
        while held:
            n = held.pop()
            if n.tag in tags:
                out.append(n)
            else:
                held += [k for k in reversed(n.kids) if isinstance(k, Node)]
        return out

    def table(self, node: Node, owner: Node | None = None) -> None:
        caption = _caption(owner or node)
        if owner is None:
            if _named(node, "equation"):
                return self.formulas(node, None)
            if caption is None and not _named(node, "tabular"):
                return None
        text = _text(caption) if caption is not None else ""
        self.count["Table"] += 1
        found = TABLE_LABEL.search(text)
        number = self.add("table", text, node, label=f"Table {found[1] if found else self.count['Table']}")
        if owner is not None:
            self.of[id(owner)] = number
        if text:
            self.add("caption", text, caption, number)
        cells, doubts = table_cells(node)
        self.cells += [(number, *c) for c in cells]
        self.reasons += doubts if cells else ["html_table_empty"]
        return None

    def figure(self, node: Node) -> list | None:
        inner = [n for n in node.below() if n.tag == "figure"]
        if _named(node, "table"):
            parts = [n for n in inner if _named(n, "figure_panel") and (c := _caption(n)) is not None and TABLE_LABEL.search(_text(c))]
            for part in parts or [node]:
                if (held := next((n for n in part.below() if n.tag == "table"), None)) is not None:
                    self.table(held, part)
            return None
        caption = _caption(node)
        text = _text(caption) if caption is not None else ""
        if CODE_LABEL.match(text):
            self.add("code", _text(node, NOISE), node)
            return None
        own = [n for n in inner if _figure_of(n) is node]
        labelled = [n for n in own if (c := _caption(n)) is not None and FIGURE_LABEL.search(_text(c))]
        if not text and (labelled or not any(n.tag in MEDIA for n in node.below())):
            return node.kids
        found = FIGURE_LABEL.search(text)
        if not found:
            self.count["Image"] += 1
        number = self.add("figure", text, node, label=f"Figure {found[1]}" if found else f"Image {self.count['Image']}")
        if text:
            self.add("caption", text, caption, number)
        self.pictures(node, [n for n in own if _named(n, "figure_panel")], number)
        return None

    def pictures(self, node: Node, parts: list[Node], number: int) -> None:
        """A figure's panels: its pictures, by its panels where it has any; one without a picture counts."""
        place = 0
        for part in parts or [node]:
            caption = _caption(part) if part is not node else None
            media = [n for n in part.below() if n.tag in MEDIA and _figure_of(n) is part]
            for picture in media or ([None] if parts else []):
                src, state = self.source(picture)
                label = (_text(caption) if caption is not None else "") or (picture.attrs.get("alt", "").strip() if picture is not None else "") or chr(ord("a") + place % 26)
                self.panels.append((number, place, label, src, state))
                place += 1
        states = [p[4] for p in self.panels if p[0] == number]
        if not states or "missing" in states:
            self.reasons.append("html_figure_media_incomplete")

    def source(self, picture: Node | None) -> tuple[str | None, str]:
        if picture is None:
            return None, "missing"
        src = picture.attrs.get("src") or picture.attrs.get("data") or (picture.attrs.get("srcset", "").split(",")[0].split() or [""])[0]
        if not src:
            return None, "embedded" if picture.tag == "svg" else "missing"
        try:
            scheme = urlparse(src).scheme
        except ValueError:
            return src, "missing"
        return src, {"data": "embedded", "http": "remote", "https": "remote"}.get(scheme, "local")

    # The paper as a whole

    def text_of(self, *parts: str) -> str:
        """The text of the first node that a class names so."""
        return next((_text(n) for n, names in self.classed if _has(names, parts)), "")

    def about(self, authors: bool = True) -> dict:
        meta: dict[str, list[str]] = {}
        for n in self.every:
            if n.tag == "meta" and (name := (n.attrs.get("name") or n.attrs.get("property") or "").lower()) and (value := n.attrs.get("content", "").strip()):
                meta.setdefault(name, []).append(value)
        out = {field: next((meta[k][0] for k in keys if k in meta), "") for field, keys in META.items()}
        out["title"] = out["title"] or next((_text(n) for n in self.every if n.tag == "h1" or _named(n, "title_document")), "")
        out["abstract"] = out["abstract"] or re.sub(r"^Abstract\s*", "", self.text_of("abstract"), flags=re.I).strip()
        out["license"] = out["license"] or self.text_of("license")
        number = PREPRINT.search(self.url if "arxiv.org/" in self.url.lower() else "") or PREPRINT.search((meta.get("citation_arxiv_id") or [""])[0])
        out["preprint"] = number[1] if number else ""
        out["language"] = next((n.attrs.get("lang", "") for n in self.every if n.tag == "html"), "")
        out["keywords"] = _unique(w.strip() for k in ("citation_keywords", "keywords") for v in meta.get(k, []) for w in re.split("[,;]", v))
        if authors:
            out["authors"] = self.named_authors() or self.listed_authors(meta)
        return out

    def named_authors(self) -> list[dict]:
        """Authors by the marked names on the page, each with what stands in the same author's part."""
        out: dict[tuple[int, str], dict] = {}
        for node, names in self.classed:
            if not _has(names, ("author_name", "personname")) or not (name := _text(node)):
                continue
            part = node
            while part.up is not None and not (_named(part, "creator", "author") and part is not node):
                part = part.up
            part = node if part.up is None else part
            within = lambda *names, part=part: _unique(_text(n) for n in part.below() if _named(n, *names))
            out.setdefault((id(part), name), {"name": name, "affiliations": within("affiliation", "institution"), "emails": _unique(EMAIL.findall(_text(part))), "notes": within("author_notes", "role_author")})
        return [*out.values()]

    def listed_authors(self, meta: dict[str, list[str]]) -> list[dict]:
        """Authors by meta tags; the n-th institution and address are the n-th author's."""
        names = meta.get("citation_author") or meta.get("author") or []
        nth = lambda key, n: meta.get(key, [])[n : n + 1]
        return [{"name": x, "affiliations": nth("citation_author_institution", i), "emails": nth("citation_author_email", i), "notes": []} for i, x in enumerate(names)]

    def block_of(self, node: Node | None) -> int | None:
        while node is not None and id(node) not in self.of:
            node = node.up
        return None if node is None else self.of[id(node)]

    def links(self) -> list[tuple]:
        out = []
        for node in self.every:
            if node.tag != "a" or not (href := node.attrs.get("href", "").strip()):
                continue
            try:
                target = href if href.startswith("#") or urlparse(href).scheme else urljoin(self.url, href)
                safe = target.startswith("#") or urlparse(target).scheme in (("http", "https", "mailto") if target == href else ("http", "https"))
            except ValueError:
                safe = False
            if safe:
                kind = "citation" if _named(node, "bib", "cite", "ref") else "internal" if href.startswith("#") else "external"
                out.append((self.block_of(node), kind, target, _text(node)))
            else:
                self.reasons.append("html_unsafe_reference_ignored")
        return out

    def anchors(self) -> list[tuple]:
        """Names on the page with the block they stand for: the node's own, else the first within it, else
        the one it stands in; and whether that is an entry of the bibliography."""
        first: dict[int, int] = {}
        for node in reversed(self.every):
            if id(node) in self.of:
                first[id(node)] = self.of[id(node)]
            if id(node) in first and node.up is not None:
                first[id(node.up)] = first[id(node)]
        out: dict[str, tuple] = {}
        for node in self.every:
            if name := node.attrs.get("id", "").strip():
                block = first[id(node)] if id(node) in first else self.block_of(node)
                entry = _named(node, "bibitem") or node.attrs.get("role") == "doc-biblioentry"
                out.setdefault(name, (name, block, entry))
        return [*out.values()]

    def row(self, page: int, fields: tuple[str, ...]) -> dict:
        out: dict = {"page": page}
        judged = "status" in fields or "reasons" in fields
        if judged or any(f in ABOUT for f in fields):
            out |= self.about("authors" in fields)
        if not all(f in ABOUT for f in fields):
            self.walk()
            links = self.links() if judged or "links" in fields else []
            anchors = self.anchors() if "anchors" in fields else []
            out["blocks"] = self.blocks
            for field, rows in (("cells", self.cells), ("panels", self.panels), ("links", links), ("anchors", anchors)):
                out[field] = [dict(zip(_NAMES[field], r, strict=True)) for r in rows] if field in fields else []
        if judged:
            reasons = ["html_title_missing"] * (not out["title"]) + ["html_body_empty"] * (not any(b["text"] for b in self.blocks)) + self.reasons
            out |= {"status": "rejected" if "html_body_empty" in reasons else "degraded" if reasons else "ok", "reasons": _unique(reasons)}
        for n in self.every:  # a page's nodes hold each other; so they go at once
            n.up, n.kids = None, []
        return {k: out[k] for k in ("page", *fields)}


def papers(rows: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row a page: key, what the page says about the paper, status and reasons, and arrays of authors,
    blocks, cells, panels, links and anchors; or of these the fields named. Write it, if more than one of them
    is needed."""
    fields = fields or tuple(f for f in FOUND.names if f != "page")
    schema = pa.schema([FOUND.field(f) for f in ("page", *fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK).to_pydict()
                out = [_Paper(h or "", u or "").row(k, fields) for k, h, u in zip(part["k"], part["h"], part["u"], strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    address = F.col(url).cast("string") if url else F.lit(None).cast("string")
    found = rows.select(F.col(key).cast("long").alias("k"), F.col(html).cast("string").alias("h"), address.alias("u"))
    return found.mapInArrow(run, from_arrow_schema(schema)).withColumnRenamed("page", key)


def part(found: DataFrame, name: str, key: str = "page_id", number: str | None = None) -> DataFrame:
    """One of the arrays of papers() as rows; number: a column with each row's place on its page."""
    if number:
        return found.select(key, F.posexplode(name).alias(number, "_x")).select(key, number, "_x.*")
    return found.select(key, F.explode(name).alias("_x")).select(key, "_x.*")


def entries(found: DataFrame, key: str = "page_id") -> DataFrame:
    """A row a page: key, the entries of its bibliography (entry, block, text) and the anchors on the page that its
    citations name (cites). Small beside papers(), so write this, if only bibliographies are needed."""
    entry = lambda a: F.struct(a["name"].alias("entry"), a["block"].alias("block"), F.get("blocks", a["block"])["text"].alias("text"))
    own = F.filter("links", lambda x: (x["kind"] == "citation") & F.startswith(x["target"], F.lit("#")))
    cites = F.transform(own, lambda x: F.substring(x["target"], F.lit(2), F.length(x["target"])))
    return found.select(key, F.transform(F.filter("anchors", lambda a: a["entry"]), entry).alias("entries"), cites.alias("cites"))


def bibliography(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The entries of papers' bibliographies: key, entry (its anchor), block, text, doi and year, if named,
    and cited: how often the page's citations point at it. found: what papers() or entries() gives."""
    held = found if "cites" in found.columns else entries(found, key)
    cited = held.select(key, F.explode("cites").alias("entry")).groupBy(key, "entry").agg(F.count("*").alias("cited"))
    first = lambda pattern, group=0: F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    out = part(held, "entries", key).join(cited, [key, "entry"], "left")
    return out.select(key, "entry", "block", "text", first(r"10\.\d{4,9}/[^\s\"<>]*[^\s\"<>.,;)\]]").alias("doi"), first(r"(?:^|\D)((?:19|20)\d\d)(?!\d)", 1).cast("int").alias("year"), F.coalesce("cited", F.lit(0)).cast("long").alias("cited"))


@F.arrow_udf(from_arrow_type(pa.list_(_END)))
def _ends(links: pa.Array, anchors: pa.Array) -> pa.Array:
    chunks = [pa.array([], pa.list_(_END))]
    for start in range(0, len(links), CHUNK):
        out = []
        for own, there in zip(links.slice(start, CHUNK).to_pylist(), anchors.slice(start, CHUNK).to_pylist(), strict=True):
            where = {a["name"]: a for a in reversed(there or ())}
            targets = [x["target"] for x in own or ()]
            found = [where.get(t[1:]) if (t or "").startswith("#") else None for t in targets]
            status = ["resolved" if a else "unresolved" if (t or "").startswith("#") else "outside" for t, a in zip(targets, found, strict=True)]
            out.append([{"status": s, "to_block": a and a["block"], "to_entry": a and a["entry"]} for s, a in zip(status, found, strict=True)])
        chunks.append(pa.array(out, pa.list_(_END)))
    return pa.concat_arrays(chunks)


def ends(found: DataFrame) -> DataFrame:
    """Papers with ends, for each of their links what it leads to: status (resolved, unresolved: no such anchor,
    outside) and to_block, to_entry of those resolved. Links and anchors meet within their page."""
    return found.withColumn("ends", _ends("links", "anchors"))


def references(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The links of papers: key, place, block they stand in, kind, target, label, and what they lead to:
    status (resolved, unresolved: no such anchor, outside) and to_block, to_entry of those resolved."""
    both = F.arrays_zip("links", "ends")
    return ends(found).select(key, F.posexplode(both).alias("place", "_x")).select(key, "place", "_x.links.*", "_x.ends.to_block", "_x.ends.to_entry", "_x.ends.status")


def _html(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _papers(s: SparkSession, d: str, *fields: str) -> DataFrame:
    """Documents as papers: a line a paragraph, a citation after each third; two authors; doc_id % 4 + 1
    entries of a bibliography, of which citations name five; a figure of two panels and a table."""
    doc, lit = F.col("doc_id").cast("string"), F.lit
    lines = F.transform(
        F.split(_html(F.col("text")), "\n"),
        lambda x, i: F.concat(lit('<div class="ltx_para"><p>'), x, F.when(i % 3 == 0, F.concat(lit(' <cite><a class="ltx_ref" href="#bib.bib'), (i % 5 + 1).cast("string"), lit('">c</a></cite>'))).otherwise(""), lit("</p></div>")),
    )
    entries = F.transform(F.sequence(lit(1), (F.col("doc_id") % 4 + 1).cast("int")), lambda k: F.concat(lit('<li id="bib.bib'), k.cast("string"), lit('" class="ltx_bibitem">A. Author, '), (k + 1990).cast("string"), lit(". doi:10.1000/d."), (F.col("doc_id") + k).cast("string"), lit(".</li>")))
    head = F.concat(lit("<html lang='en'><head><meta name='citation_doi' content='10.1000/d."), doc, lit("'><meta name='citation_keywords' content='k1; "), F.col("source"), lit(",k1'></head><body><nav>menu</nav><article class='ltx_document ltx_authors_1line'><h1 class='ltx_title ltx_title_document'>Paper "), doc, lit("</h1>"))
    author = lambda name, place: F.concat(lit("<span class='ltx_creator ltx_role_author'><span class='ltx_personname'>"), name, lit("</span><span class='ltx_contact ltx_role_affiliation'>"), place, lit("</span> a"), doc, lit("@x.org</span>"))
    authors = F.concat(lit("<div class='ltx_authors'>"), author(F.concat(lit("First "), doc), F.col("lang")), author(F.concat(lit("Second "), F.col("source")), lit("Institute")), lit("</div><div class='ltx_abstract'><h6>Abstract</h6><p>About "), doc, lit("</p></div>"))
    shown = F.concat(lit("<figure id='F1' class='ltx_figure'><figure class='ltx_figure_panel'><img src='a.png'></figure><figure class='ltx_figure_panel'><img alt='two' src='https://x.org/b.png'></figure><figcaption>Figure 1: see <a href='#S1'>here</a></figcaption></figure><figure class='ltx_table' id='T1'><figcaption>Table 2. T</figcaption><table><tr><th>a</th><td colspan='2'>"), doc, lit("</td></tr></table></figure>"))
    html = F.concat(head, authors, lit("<section id='S1'><h2>Body</h2>"), F.array_join(lines, ""), shown, lit("</section><section class='ltx_bibliography' id='bib'><h2>References</h2><ul class='ltx_biblist'>"), F.array_join(entries, ""), lit("</ul></section></article></body></html>"))
    rows = load(s, d, "documents").filter("text is not null").select("doc_id", "text", "source", "lang").repartition("doc_id")  # one file's documents go to many tasks
    return papers(rows.select("doc_id", html.alias("html")), "doc_id", fields=fields)


def scholarly_papers(s: SparkSession, d: str) -> DataFrame:
    """What papers made of documents say about themselves, their kinds of blocks, and all their paragraphs."""
    f = _papers(s, d, "title", "abstract", "doi", "keywords", "status", "blocks")
    kinds = lambda *names: F.size(F.filter("blocks", lambda b: b["kind"].isin(*names)))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == "paragraph"), lambda b: F.regexp_replace(b["text"], " c$", "")), "\n")
    return f.select("doc_id", "title", "abstract", "doi", F.array_join("keywords", "|").alias("keywords"), "status", kinds("heading").alias("headings"), kinds("figure", "table").alias("shown"), kinds("list_item").alias("entries"), F.sha2(text, 256).alias("digest"))


def scholarly_authors(s: SparkSession, d: str) -> DataFrame:
    return part(_papers(s, d, "authors"), "authors", "doc_id", "place").select("doc_id", "place", "name", F.array_join("affiliations", "|").alias("affiliations"), F.array_join("emails", "|").alias("emails"))


def scholarly_references(s: SparkSession, d: str) -> DataFrame:
    """How many links of each kind lead somewhere, and the kinds of block they lead to."""
    to = F.transform("ends", lambda e, i: F.struct(F.get("links", i)["kind"].alias("kind"), e["status"].alias("status"), F.get("blocks", e["to_block"])["kind"].alias("to_kind")))
    return ends(_papers(s, d, "blocks", "links", "anchors")).select("doc_id", F.inline(to)).groupBy("doc_id", "kind", "status", "to_kind").agg(F.count("*").alias("n"))


def scholarly_bibliography(s: SparkSession, d: str) -> DataFrame:
    from marlstone.shared import written

    return bibliography(written(entries(_papers(s, d, "blocks", "links", "anchors"), "doc_id"), "entries"), "doc_id").select("doc_id", "entry", "doi", "year", "cited")


def scholarly_shown(s: SparkSession, d: str) -> DataFrame:
    """Figures' panels and tables' cells as rows of one table."""
    f = _papers(s, d, "blocks", "cells", "panels").select("doc_id", F.explode(F.concat(F.transform("panels", lambda p: F.struct(p["block"].alias("block"), p["label"].alias("what"), p["state"].alias("kind"))), F.transform("cells", lambda c: F.struct(c["block"].alias("block"), c["text"].alias("what"), c["role"].alias("kind"))))).alias("x"), F.col("blocks"))
    return f.select("doc_id", F.get("blocks", F.col("x.block"))["label"].alias("label"), "x.what", "x.kind")


QUERIES = {f.__name__: f for f in (scholarly_papers, scholarly_authors, scholarly_references, scholarly_bibliography, scholarly_shown)}

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)"
ORACLES = {
    "scholarly_papers": rf"""
WITH {_LINES}, p AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN CASE WHEN trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') = '' THEN 'c' ELSE trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') END ELSE trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') END AS y FROM l) WHERE y <> '' GROUP BY doc_id)
SELECT d.doc_id, 'Paper ' || d.doc_id AS title, 'About ' || d.doc_id AS abstract, '10.1000/d.' || d.doc_id AS doi, 'k1|' || source AS keywords, 'ok' AS status, 2 AS headings, 2 AS shown, (d.doc_id % 4 + 1)::INT AS entries, sha256(coalesce(t, '')) AS digest FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id WHERE text IS NOT NULL""",
    "scholarly_authors": """
SELECT doc_id, 0 AS place, 'First ' || doc_id AS name, lang AS affiliations, 'a' || doc_id || '@x.org' AS emails FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 1, 'Second ' || source, 'Institute', 'a' || doc_id || '@x.org' FROM documents WHERE text IS NOT NULL""",
    "scholarly_references": f"""
WITH {_LINES}
SELECT doc_id, 'citation' AS kind, CASE WHEN i % 5 <= doc_id % 4 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN i % 5 <= doc_id % 4 THEN 'list_item' END AS to_kind, count(*) AS n FROM l WHERE i % 3 = 0 GROUP BY ALL
UNION ALL SELECT doc_id, 'internal', 'resolved', 'heading', 1 FROM documents WHERE text IS NOT NULL""",
    "scholarly_bibliography": f"""
WITH {_LINES}, c AS (SELECT doc_id, i % 5 + 1 AS k, count(*) AS n FROM l WHERE i % 3 = 0 GROUP BY ALL), e AS (SELECT doc_id, unnest(range(1, doc_id % 4 + 2)) AS k FROM documents WHERE text IS NOT NULL)
SELECT e.doc_id, 'bib.bib' || e.k AS entry, '10.1000/d.' || (e.doc_id + e.k) AS doi, (1990 + e.k)::INT AS year, coalesce(n, 0)::BIGINT AS cited FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k""",
    "scholarly_shown": """
SELECT doc_id, x.* FROM documents, (VALUES ('Figure 1', 'a', 'local'), ('Figure 1', 'two', 'remote'), ('Table 2', 'a', 'row_header')) x(label, what, kind) WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'Table 2', doc_id::VARCHAR, 'data' FROM documents WHERE text IS NOT NULL""",
}
