"""Chunkers in Python for formats that need a real parser: code, HTML, YAML, XML, office files, API descriptions, exports.

Each takes text (or bytes) and returns chunks (content, start_line, end_line, context, cues, category). They run inside
``chunks.chunk_files`` in Arrow batches; nothing here touches Spark.
"""

from __future__ import annotations

import ast
import datetime
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

SOFT_LIMIT, BLOCK = 3000, 20


class Chunk(NamedTuple):
    content: str
    start_line: int
    end_line: int
    context: str
    cues: list[str]
    category: str


# ---- text ----

_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.findall(text) if s.strip()]


def text_windows(text: str, size: int = 3, step: int = 2, least: int = 50, most: int = 2000) -> list[Chunk]:
    s = sentences(text)
    lines = text.count("\n") + 1
    if len(s) <= size or len(text.encode()) < least:
        return [Chunk(text.strip(), 1, lines, "text", ["lang:text", "type:text_content"], "Prose")] if text.strip() else []
    out = []
    for w, i in enumerate(range(0, len(s), step)):
        body = " ".join(s[i : i + size])
        if len(body.encode()) >= least:
            out.append(Chunk(body[:most], 1 + lines * i // len(s), 1 + lines * min(i + size, len(s)) // len(s), f"window:{w}", ["lang:text", "type:sentence_window", f"window:{w}"], "Prose"))
    return out


def pack_sentences(parts: list[str], least: int = 80, most: int = 500, count: int = 3) -> list[str]:
    """Greedy: a pack closes when the next sentence would pass ``most`` bytes or it has ``count``; short packs are dropped."""
    out, have, size = [], [], 0
    for s in [*parts, None]:
        n = 0 if s is None else len(s.encode()) + 1
        if have and (s is None or size + n > most or len(have) >= count):
            body = " ".join(have)
            if len(body.encode()) >= least:
                out.append(body)
            have, size = [], 0
        if s is not None:
            have.append(s)
            size += n
    return out


def pack_parallel(parts: list[str], batch: int = 20, over: int = 50) -> list[str]:
    """As pack_sentences; more than ``over`` sentences are packed in independent batches."""
    if len(parts) <= over:
        return pack_sentences(parts)
    return [p for i in range(0, len(parts), batch) for p in pack_sentences(parts[i : i + batch])]


# ---- code ----


def _blocks(text: str, lang: str, first: int = 1) -> list[Chunk]:
    lines = text.split("\n")
    return [
        Chunk(body, first + i, first + min(i + BLOCK, len(lines)) - 1, f"block:{first + i}", [f"lang:{lang}", "type:block"], "Code")
        for i in range(0, len(lines), BLOCK)
        if (body := "\n".join(lines[i : i + BLOCK])).strip()
    ]


def _made(text: str, start: int, end: int, kind: str, name: str, lang: str, label: str = "name") -> Chunk:
    return Chunk(text, start, end, f"{kind}:{name}", [f"lang:{lang}", f"type:{re.sub('_(declaration|definition|item|rule|set)$', '', re.sub('_set$', '', kind))}", f"{label}:{name}"], "Code")


def code_python(text: str) -> list[Chunk]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last: more nested than its parser's stack takes
        return _blocks(text, "python")
    lines, out = text.split("\n"), []

    def visit(node):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([c.lineno, *[d.lineno for d in c.decorator_list]])
                body = "\n".join(lines[start - 1 : c.end_lineno])
                kind = "class_definition" if isinstance(c, ast.ClassDef) else "function_definition"
                if len(body.encode()) <= SOFT_LIMIT:
                    out.append(_made(body, start, c.end_lineno, kind, c.name, "python"))
                    continue
                n = len(out)
                visit(c)
                if len(out) == n:
                    out.extend(_blocks(body, "python", start))
            else:
                visit(c)

    visit(tree)
    return out or _blocks(text, "python")


#: per language: (kind, pattern whose group 1 is the name)
_DECL = {
    "rust": [("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"), ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("impl_item", r"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("mod_item", r"(?:pub\s+)?mod\s+(\w+)")],
    "typescript": [("function_declaration", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class_declaration", r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface_declaration", r"(?:export\s+)?interface\s+(\w+)"), ("enum_declaration", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)")],
    "javascript": [("function_declaration", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class_declaration", r"(?:export\s+)?(?:default\s+)?class\s+(\w+)")],
    "go": [("function_declaration", r"func\s+(\w+)\s*[\[(]"), ("method_declaration", r"func\s+\([^)]*\)\s*(\w+)"), ("type_declaration", r"type\s+(\w+)\s+(?:struct|interface)")],
    "java": [("class_declaration", r"(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)"), ("interface_declaration", r"(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("enum_declaration", r"(?:(?:public|private|protected)\s+)*enum\s+(\w+)"), ("method_declaration", r"(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "php": [("function_definition", r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)"), ("class_declaration", r"(?:(?:abstract|final)\s+)*class\s+(\w+)"), ("interface_declaration", r"interface\s+(\w+)"), ("trait_declaration", r"trait\s+(\w+)")],
}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _blank(text: str) -> str:
    """Comments and strings as blanks of the same length, so that braces count."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), text)


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif text[i] == ";" and depth == 0:
            return i + 1
    return len(text)


def code_braces(text: str, lang: str) -> list[Chunk]:
    clean = _blank(text)
    decl = [(k, re.compile(rf"(?:^|(?<=[\n;{{}}>]))[ \t]*(?:<\?php\s+)?({p})")) for k, p in _DECL[lang]]

    def within(lo: int, hi: int) -> list[Chunk]:
        out, at = [], lo
        while at < hi:
            best = None
            for kind, p in decl:
                m = p.search(clean, at, hi)
                if m and (best is None or m.start(1) < best[1].start(1)):
                    best = (kind, m)
            if not best:
                break
            kind, m = best
            end = min(_closing(clean, m.end(1)), hi)
            body = text[m.start(1) : end]
            first = text.count("\n", 0, m.start(1)) + 1
            if len(body.encode()) <= SOFT_LIMIT:
                out.append(_made(body, first, first + body.count("\n"), kind, m.group(2), lang))
            else:
                brace = clean.find("{", m.end(1), end)
                out.extend((within(brace + 1, end - 1) if brace >= 0 else []) or _blocks(body, lang, first))
            at = max(end, m.end(1))
        return out

    return within(0, len(text)) or _blocks(text, lang)


def code_css(text: str) -> list[Chunk]:
    clean, out, at = _blank(text), [], 0
    while (brace := clean.find("{", at)) >= 0:
        end = _closing(clean, brace)
        start = at + len(clean[at:brace]) - len(clean[at:brace].lstrip())
        name = text[start:brace].strip()
        first = text.count("\n", 0, start) + 1
        out.append(Chunk(text[start:end], first, first + text.count("\n", start, end), f"rule_set:{name}", ["lang:css", "type:rule", f"selector:{name}"], "Code"))
        at = end
    return out or _blocks(text, "css")


# ---- markup ----

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SELF_CLOSING = {"p": {"p", "div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "footer", "header", "nav"}, "li": {"li"}}


class Node:
    __slots__ = ("tag", "attrs", "kids", "line", "parent")

    def __init__(self, tag, attrs, line, parent):
        self.tag, self.attrs, self.kids, self.line, self.parent = tag, attrs, [], line, parent

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.kids))
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, 1, None)

    def handle_starttag(self, tag, attrs):
        if self.now.tag in _SELF_CLOSING and tag in _SELF_CLOSING[self.now.tag]:
            self.now = self.now.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.getpos()[0], self.now)
        self.now.kids.append(n)
        if tag not in _VOID:
            self.now = n

    def handle_startendtag(self, tag, attrs):
        self.now.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.getpos()[0], self.now))

    def handle_endtag(self, tag):
        n = self.now
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.now = n.parent

    def handle_data(self, data):
        self.now.kids.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def html_elements(html: str) -> list[Chunk]:
    out = []
    for n in list(tree(html).walk())[1:]:
        body = " ".join(n.text().split())
        cues = ["lang:html", "type:element", f"tag:{n.tag}"] + ([f"id:{n.attrs['id']}"] if n.attrs.get("id") else []) + [f"class:{c}" for c in n.classes()]
        out.append(Chunk(body, n.line, n.line, f"html:{n.tag}", cues, "WebContent"))
    return out


_CONTAINERS = [lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: {"post-content", "article-content", "entry-content", "content"} & set(n.classes()), lambda n: n.tag == "body"]
_SKIP_TAGS, _SKIP_CLASSES = set("aside footer header nav noscript script style".split()), {"ad", "ads", "sidebar", "menu", "navigation", "advertisement", "comments"}


def _scope(root: Node) -> Node:
    nodes = list(root.walk())
    for test in _CONTAINERS:
        for n in nodes:
            if test(n) and sum(isinstance(k, str) and bool(k.strip()) for m in n.walk() for k in m.kids) > 5:
                return n
    return root


def _outside(n: Node, extra: frozenset = frozenset()) -> bool:
    while n is not None:
        if n.tag in _SKIP_TAGS or (_SKIP_CLASSES | extra) & set(n.classes()):
            return True
        n = n.parent
    return False


def article(html: str) -> str:
    """Readable text of a page: paragraphs, headings, items and quotes of its main container."""
    root = tree(html)
    parts = []
    for n in _scope(root).walk():
        if n.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre") and not _outside(n):
            t = " ".join(n.text().split())
            if t and (n.tag.startswith("h") or len(t.encode()) > 20 or t.endswith((".", ":"))):
                parts.append(t)
    return "\n\n".join(parts) or " ".join(root.text().split())


def content_links(html: str, base: str) -> list[str]:
    out: dict[str, None] = {}
    for n in _scope(tree(html)).walk():
        href = (n.attrs.get("href") or "").strip() if n.tag == "a" else ""
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:", "tel:")) or _outside(n, frozenset({"toc", "breadcrumb", "pagination"})):
            continue
        try:
            out[urljoin(base, href)] = None
        except ValueError:
            continue
    return list(out)


def page_cues(html: str, url: str) -> list[str]:
    root = tree(html)
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "") for n in root.walk() if n.tag == "meta"}
    out = ["source:url", f"domain:{urlsplit(url).hostname or ''}"]
    title = next((n.text().strip() for n in root.walk() if n.tag == "title"), "")
    out += [f"title:{title[:100]}"] if title else []
    out += [f"description:{meta['description'][:200]}"] if meta.get("description") else []
    out += [f"keyword:{k.strip().lower()}" for k in meta.get("keywords", "").split(",")[:5] if k.strip()]
    for h in range(1, 7):
        heads = [" ".join(n.text().split()) for n in root.walk() if n.tag == f"h{h}"]
        out += [f"h{h}:{t}" for t in [t for t in heads if t and len(t.encode()) <= 100][:3]]
    for k in ("article:published_time", "date", "pubdate", "dc.date"):
        if re.match(r"\d{4}-\d\d-\d\d", meta.get(k, "")):
            out.append(f"date:{meta[k][:10]}")
            break
    return out


def web_page(html: str, url: str, parallel: bool = False) -> list[Chunk]:
    cues, packs = page_cues(html, url), (pack_parallel if parallel else pack_sentences)(sentences(article(html)))
    packs = packs or [f"URL: {url} (no content extracted)"]
    return [Chunk(p, i + 1, i + 1, f"web:{i}", cues, "WebContent") for i, p in enumerate(packs)]


def xml_root(text: str) -> list[Chunk]:
    try:
        e = ET.fromstring(text)
    except ET.ParseError:
        return text_windows(text)
    tag = e.tag.split("}")[-1]
    body = " ".join("".join(e.itertext()).split())
    return [Chunk(body, 1, text.count("\n") + 1, f"xml:{tag}", ["lang:xml", "type:xml_element", f"tag:{tag}", *[f"attr:{k.split('}')[-1]}" for k in e.attrib], *([f"id:{e.attrib['id']}"] if "id" in e.attrib else [])], "Structured")]


# ---- structured ----

_METHODS = frozenset("delete get head options patch post put trace".split())


def api_operations(spec: dict) -> list[Chunk]:
    api = str((spec.get("info") or {}).get("title", "api"))
    out = []
    for path, item in (spec.get("paths") or {}).items():
        for method, op in (item or {}).items():
            if method.lower() in _METHODS and isinstance(op, dict):
                m = method.upper()
                cues = ["type:api_operation", f"method:{m.lower()}", f"path:{path}", *([f"operation:{op['operationId']}"] if op.get("operationId") else []), f"api:{api}", *[f"tag:{t}" for t in op.get("tags") or []]]
                out.append(Chunk(f"{m} {path} - {op.get('summary', '')}", 1, 1, f"api:{m} {path}", cues, "ApiSpec"))
    return out


def _entries(data, kind: str, text: str) -> list[Chunk]:
    if isinstance(data, dict):
        if "swagger" in data or "ApiSpec" in data or "apispec" in data:
            return api_operations(data) or text_windows(text)
        return [Chunk(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)}", 1, 1, f"{kind}_key:{k}", [f"type:{kind}_entry", f"key:{k}"], "Structured") for k, v in data.items()]
    if isinstance(data, list) and kind == "json":
        return [Chunk(json.dumps(v, ensure_ascii=False, default=str), 1, 1, f"json_index:{i}", ["type:json_item", f"index:{i}"], "Structured") for i, v in enumerate(data)]
    return text_windows(text)


def json_entries(text: str) -> list[Chunk]:
    try:
        return _entries(json.loads(text), "json", text)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return text_windows(text)


def yaml_entries(text: str) -> list[Chunk]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need PyYAML") from e
    try:
        return _entries(yaml.safe_load(text), "yaml", text)
    except (yaml.YAMLError, ValueError, TypeError, AttributeError, RecursionError):  # dates and numbers out of range, keys that JSON can't say, aliases of themselves
        return text_windows(text)


def useful_cell(v: str) -> bool:
    v = v.strip()
    if len(v.encode()) <= 3 or "@" in v and "." in v or re.fullmatch(r"[\d.,+\-\s]+", v) or re.fullmatch(r"[0-9a-fA-F-]{8,}", v):
        return False
    return sum(c.isdigit() for c in v) <= 0.5 * len(v)


def markdown(text: str) -> list[Chunk]:
    out, head, first, body = [], "root", 1, []
    for i, line in enumerate([*text.split("\n"), None], 1):
        if line is None or line.startswith("#"):
            if "\n".join(body).strip():
                out.append(Chunk("\n".join(body).strip(), first, i - 1, f"section:{head}", ["type:markdown_section", f"header:{head}"], "Prose"))
            if line is not None:
                head, first, body = line.strip("#").strip(), i, [line]
        else:
            body.append(line)
    return out


def csv_rows(text: str, name: str = "data") -> list[Chunk]:
    import csv

    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))  # a quote that never ends makes one long cell
    rows = list(csv.reader(io.StringIO(text, newline="")))  # a lone carriage return ends a row too
    out = []
    for n, row in enumerate(rows[1:], 1):
        cells = [(h, v.strip()) for h, v in zip(rows[0], row) if useful_cell(v)]
        if cells:
            out.append(Chunk(" | ".join(v for _, v in cells), n + 1, n + 1, f"csv_row:{n}", ["type:csv_row", f"file:{name}", f"row:{n}", *[f"column:{h}" for h, _ in cells]], "Structured"))
    return out


# ---- office ----

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx(data: bytes, name: str) -> list[Chunk]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = "\n".join(t for p in root.iter(_W + "p") if (t := " ".join(r.text for r in p.iter(_W + "t") if r.text)))
    return [Chunk(p, i + 1, i + 1, f"docx:{i}", ["type:docx", f"file:{name}"], "Prose") for i, p in enumerate(pack_sentences(sentences(text)))]


def xlsx(data: bytes, name: str) -> list[Chunk]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.attrib["name"] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
    out = []
    for k, sheet in enumerate(names, 1):
        rows = []
        for r in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(_S + "row"):
            cells = {}
            for c in r.iter(_S + "c"):
                v = c.find(_S + "v")
                inline = c.find(_S + "is")
                text = "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else "" if v is None else shared[int(v.text)] if c.attrib.get("t") == "s" else v.text
                cells[re.sub(r"\d", "", c.attrib.get("r", ""))] = text or ""
            rows.append((int(r.attrib.get("r", len(rows) + 1)), cells))
        if not rows:
            continue
        head = rows[0][1]
        for n, cells in rows[1:]:
            good = [(head.get(c, c), v.strip()) for c, v in cells.items() if useful_cell(v)]
            if good:
                out.append(Chunk(" | ".join(v for _, v in good), n, n, f"excel_row:{n}", ["type:excel_row", f"file:{name}", f"sheet:{sheet}", f"row:{n}", *[f"column:{h}" for h, _ in good]], "Structured"))
    return out


# ---- exports ----

_WHATSAPP = re.compile(r"^\[((?:\d\d?/){2}\d{2,4}),\s+\d\d?(?::\d\d){1,2}(?:\s*[AP]M)?\]\s+([^:\n]+):\s+(.*(?:\n(?!\[).*)*)", re.M)
_WATCH = re.compile(r"Watched\s*<a\b[^<>]*>\s*([^<]+)</a>.*?([A-Z][a-z]{2} \d{1,2}, \d{4})", re.S)
_SEARCH = re.compile(r"Searched for\s*<a\b[^<>]*>\s*([^<]+)</a>.*?([A-Z][a-z]{2} \d{1,2}, \d{4})", re.S)


def _day(seconds: float) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y-%m-%d")


def _message(i: int, body: str, cues: list[str]) -> Chunk:
    return Chunk(body, i, i, f"message:{i}", cues, "Conversation")


def whatsapp(text: str) -> list[Chunk]:
    out = []
    for m in _WHATSAPP.finditer(text):
        body = m.group(3).strip()
        if len(body) >= 3 and "omitted" not in body.lower():
            out.append(_message(text.count("\n", 0, m.start()) + 1, body, ["platform:whatsapp", "type:message", f"sender:{m.group(2).strip().lower().replace(' ', '_')}", f"date:{m.group(1).replace('/', '-')}"]))
    return out


def instagram(text: str) -> list[Chunk]:
    out = []
    for i, m in enumerate(json.loads(text)):
        body = m.get("content") or ""
        if not body or "Liked a message" in body or "sent an attachment" in body:
            continue
        cues = ["platform:instagram", "type:message", f"sender:{str(m.get('sender_name', '')).lower().replace(' ', '_')}", f"date:{_day(m.get('timestamp_ms', 0) / 1e3)}"]
        link = (m.get("share") or {}).get("link")
        if link:
            cues += ["has:shared_link", f"domain:{(urlsplit(link).hostname or '').replace('.', '_')}"]
        out.append(_message(i + 1, body, cues))
    return out


def chrome(text: str) -> list[Chunk]:
    out, seen = [], set()
    for i, e in enumerate(json.loads(text).get("Browser History", [])):
        url, title = e.get("url", ""), e.get("title") or ""
        if url in seen or not title or title == "Untitled":
            continue
        seen.add(url)
        out.append(_message(i + 1, title, ["platform:chrome", "type:visit", f"domain:{urlsplit(url).hostname or ''}", f"date:{_day(e.get('time_usec', 0) / 1e6)}"]))
    return out


def youtube(html: str) -> list[Chunk]:
    out, seen = [], set()
    for kind, p in (("watched", _WATCH), ("searched", _SEARCH)):
        for m in p.finditer(html):
            title = m.group(1).strip()
            if title not in seen:
                seen.add(title)
                day = datetime.datetime.strptime(m.group(2), "%b %d, %Y").strftime("%Y-%m-%d")
                out.append(_message(len(out) + 1, title, ["platform:youtube", f"type:{kind}", f"date:{day}"]))
    return out


def social(path: str, text: str) -> list[Chunk] | None:
    """Chunks of an export that its path or its first 500 characters tell, else None."""
    p, head = path.lower(), text[:500]
    try:
        if "whatsapp" in p or _WHATSAPP.search(head):
            return whatsapp(text)
        if "instagram" in p or '"sender_name"' in head and '"timestamp_ms"' in head:
            return instagram(text)
        if "chrome" in p and "history" in p or '"Browser History"' in head:
            return chrome(text)
        if "youtube" in p or "Watched" in head and "<a" in head and "youtube" in head.lower():
            return youtube(text)
    except (ValueError, AttributeError, TypeError, OverflowError, OSError, RecursionError):
        return text_windows(text)
    return None


_BY_EXT = {
    "py": code_python, "rs": lambda t: code_braces(t, "rust"), "ts": lambda t: code_braces(t, "typescript"), "tsx": lambda t: code_braces(t, "typescript"), "js": lambda t: code_braces(t, "javascript"), "jsx": lambda t: code_braces(t, "javascript"),
    "go": lambda t: code_braces(t, "go"), "java": lambda t: code_braces(t, "java"), "php": lambda t: code_braces(t, "php"), "css": code_css, "html": html_elements, "htm": html_elements, "md": markdown, "csv": csv_rows, "json": json_entries,
    "yaml": yaml_entries, "yml": yaml_entries, "xml": xml_root, "txt": text_windows, "log": text_windows,
}


def chunk(path: str, data: str | bytes) -> list[Chunk]:
    """Chunks of a file; an unknown type has none, and neither have presentations, nor PDF files (there is no parser here)."""
    ext = path.rsplit(".", 1)[-1] if "." in path else ""
    name = path.rsplit("/", 1)[-1]
    if ext in ("docx", "xlsx"):
        try:
            return (docx if ext == "docx" else xlsx)(data.encode() if isinstance(data, str) else data, name)
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, KeyError, ET.ParseError, ValueError, IndexError):
            return []
    if isinstance(data, bytes):
        try:
            data = data.decode()
        except UnicodeDecodeError:
            return []
    got = social(path, data)
    if got is not None:
        return got
    return _BY_EXT[ext](data) if ext in _BY_EXT else []
