"""Format parsers: bytes or text -> a parsed document with Markdown content. Pure Python, run by the readers' workers."""

from __future__ import annotations

import csv
import html
import io
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

from chunkloom.errors import MissingDependency, ParseError, UnsupportedFormat


@dataclass
class Parsed:
    content: str
    title: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    authoritative: bool = False  #: its title goes before the file's name


Parser = Callable[[str, str], Parsed]  #: (text, source)
_BY_NAME: dict[str, Parser] = {}
_BY_SUFFIX: dict[str, str] = {}


def register_parser(name: str, suffixes: tuple[str, ...], parser: Parser) -> None:
    """The last registered of a name or suffix wins."""
    _BY_NAME[name] = parser
    _BY_SUFFIX.update(dict.fromkeys(suffixes, name))


def supported_suffixes() -> list[str]:
    return sorted(_BY_SUFFIX)


def parser_for(path: str) -> tuple[str, Parser]:
    m = re.search(r"\.[^./]+$", path.lower())
    if not m or m[0] not in _BY_SUFFIX:
        raise UnsupportedFormat(f"no parser for {path}", hint=f"supported: {', '.join(supported_suffixes())}")
    return _BY_SUFFIX[m[0]], _BY_NAME[_BY_SUFFIX[m[0]]]


def decode(data: bytes, source: str = "") -> str:
    """The first of a chain of encodings that fits; a NUL near the start means binary (unless UTF-16 says so)."""
    bom = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    if not bom and b"\0" in data[:8192]:
        raise ParseError(f"{source}: binary content")
    for encoding in ("utf-8-sig", *["utf-16"] * bom, "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def parse_text(text: str, source: str = "") -> Parsed:
    t = re.sub(r"\r\n?", "\n", text)
    lines = [x.strip() for x in t.split("\n")[:9]]
    return Parsed(t, next((x for x in lines if 0 < len(x) <= 120), ""))


def front_matter(text: str) -> tuple[dict, str]:
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    rest = text[m.end() :]
    try:
        import yaml

        found = yaml.safe_load(m[1])
    except Exception:  # whatever the YAML parser stumbles over, simple lines may still be read
        pairs = (x.split(":", 1) for x in m[1].split("\n") if ":" in x)
        found = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    return (found if isinstance(found, dict) else {}), rest


def first_heading(text: str) -> str:
    from chunkloom.operators.blocks import analyze

    return next((b.text for b in analyze(text) if b.is_heading), "")


def parse_markdown(text: str, source: str = "") -> Parsed:
    meta, body = front_matter(re.sub(r"\r\n?", "\n", text))
    body = re.sub(r"(?m)^([^\n]+)\n={3,}[ \t]*$", r"# \1", body)
    body = re.sub(r"(?m)^([^-*|\n][^\n]*)\n-{3,}[ \t]*$", r"## \1", body)
    title = str(meta.get("title") or "") or first_heading(body)
    return Parsed(body.strip("\n"), title, {str(k): v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for k, v in meta.items()}, bool(title))


_DROPPED = frozenset("script style noscript template svg iframe".split())
_BOILERPLATE = frozenset("nav footer aside form".split())
_BLOCKS = frozenset("address article blockquote body dd div dl dt fieldset figcaption figure header hr html main p section".split())


class _Markdown(HTMLParser):
    """Events -> Markdown lines. What is skipped is a stack, so an inner closing tag ends only what it opened."""

    def __init__(self, boilerplate: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.skip_tags = _DROPPED | (_BOILERPLATE if boilerplate else frozenset())
        self.out: list[str] = []
        self.meta: dict[str, str] = {}
        self.title, self.in_title = "", False
        self.skipped: list[str] = []
        self.lists: list[list] = []
        self.pre: list[str] | None = None
        self.language = ""
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.quotes = 0

    def put(self, text: str) -> None:
        (self.cell if self.cell is not None else self.out).append(text)

    def line(self, n: int = 2) -> None:
        if self.cell is None:
            self.out.append("\n" * n)

    def end_cell(self) -> None:
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th", "tr"):
            self.end_cell()
        a = {k: v or "" for k, v in attrs}
        if self.skipped or tag in self.skip_tags:
            if tag in self.skip_tags:
                self.skipped.append(tag)
            return
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = a.get("name", a.get("property", "")).lower()
            if name in ("description", "author", "keywords") or name.startswith("og:"):
                self.meta[name] = a.get("content", "")
        elif re.fullmatch("h[1-6]", tag):
            self.line()
            self.put("#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre, self.language = [], ""
            self.language = self._language(a)
        elif tag == "code":
            if self.pre is not None:
                self.language = self.language or self._language(a)
            else:
                self.put("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.line(1 if len(self.lists) > 1 else 2)
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            self.line(1)
            self.put("\x01" * 2 * depth + mark)
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag == "blockquote":
            self.line()
            self.put("> ")
        elif tag == "br":
            self.put("\n" if self.cell is None else " ")
        elif tag == "hr":
            self.line()
            self.put("---")
            self.line()
        elif tag == "img" and a.get("alt"):
            self.put(f"[image: {a['alt']}]")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag in _BLOCKS:
            self.line()

    @staticmethod
    def _language(a: dict) -> str:
        m = re.search(r"(?:language|lang)-([\w+#.-]+)", a.get("class", ""))
        return m[1] if m else ""

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = False
        elif tag == "pre" and self.pre is not None:
            body = "".join(self.pre).strip("\n").replace(" ", "\x01").replace("\n", "\x02")
            self.pre = None
            self.line()
            self.put(f"```{self.language}\x02{body}\x02```")
            self.line()
        elif tag == "code" and self.pre is None:
            self.put("`")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.line(1 if self.lists else 2)
        elif tag in ("td", "th", "tr"):
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                lines = [f"| {' | '.join(r)} |" for r in rows]
                lines.insert(1, f"|{' --- |' * width}")
                self.line()
                self.put("\n".join(lines))
                self.line()
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag in _BLOCKS or re.fullmatch("h[1-6]|li", tag):
            self.line(1 if tag == "li" else 2)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.skipped:
            return
        elif self.pre is not None:
            self.pre.append(data)
        elif data.strip():
            self.put(re.sub(r"\s+", " ", data))
        elif data and self.cell is None and self.out and not self.out[-1].endswith(("\n", " ")):
            self.put(" ")


def html_to_markdown(source: str, boilerplate: bool = True) -> tuple[str, str, dict[str, str]]:
    """(title, Markdown, metadata); indents of lists and code survive the tidying of white space."""
    p = _Markdown(boilerplate)
    p.feed(source)
    p.close()
    t = re.sub(r"[ \t]+", " ", "".join(p.out))
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", t)).replace("\x01", " ").replace("\x02", "\n").strip()
    t = re.sub(r"(?m)^(\*\*|\*)\s*\1$", "", t)
    m = re.search(r"(?m)^#{1,6} (.+)$", t)
    return " ".join(p.title.split()) or (m[1].strip() if m else ""), t, p.meta


def parse_html(text: str, source: str = "") -> Parsed:
    title, markdown, meta = html_to_markdown(text)
    return Parsed(markdown, title, meta, bool(title))


def _scalar(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _label(k) -> str:
    return str(k).replace("_", " ")


def _render(value, depth: int, name: str = "") -> list[str]:
    head = [f"{'#' * min(depth, 6)} {name}"] if name else []
    if isinstance(value, dict):
        if depth > 5:
            return [*head, json.dumps(value, ensure_ascii=False, default=str)]
        out = list(head)
        for k, v in value.items():
            out += _render(v, depth + 1, _label(k)) if isinstance(v, (dict, list)) else [f"- {_label(k)}: {_scalar(v)}"]
        return out
    if isinstance(value, list):
        if not value:
            return [*head, "(empty)"]
        if not any(isinstance(v, (dict, list)) for v in value):
            return [*head, ", ".join(map(_scalar, value))]
        return head + [x for i, v in enumerate(value) for x in (_render(v, depth + 1, f"{name or 'item'} {i + 1}") if isinstance(v, (dict, list)) else [f"- {_scalar(v)}"])]
    return [*head, _scalar(value)]


def _named(record, keys: tuple[str, ...]) -> str:
    return next((_scalar(record[k]) for k in keys if _scalar(record.get(k))), "") if isinstance(record, dict) else ""


def load_json(text: str, source: str = ""):
    """One value, or the values of its lines; a line that isn't JSON is an error with its number."""
    try:
        return json.loads(text)
    except ValueError:
        out = []
        for i, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    out.append(json.loads(line))
                except ValueError as e:
                    raise ParseError(f"{source}: line {i}: {e}") from e
        return out


def parse_json(text: str, source: str = "") -> Parsed:
    data = load_json(text, source)
    if isinstance(data, list):
        lines = []
        for i, r in enumerate(data, 1):
            lines += [*_render(r, 2, _named(r, ("title", "name", "heading", "id", "slug")) or f"Record {i}"), ""]
        return Parsed("\n".join(lines).strip())
    title = _named(data, ("title", "name", "id", "heading"))
    return Parsed("\n".join(_render(data, 1, title)).strip(), title, {}, bool(title))


def parse_csv(text: str, source: str = "", mode: str = "records") -> Parsed:
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel_tab if source.lower().endswith(".tsv") else csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)]
    if not rows:
        return Parsed("")
    head = [c.strip() or f"column_{i}" for i, c in enumerate(rows[0], 1)]
    body = [(r + [""] * len(head))[: len(head)] for r in rows[1:]]
    if mode == "table" or len(body) <= 1:
        lines = [f"| {' | '.join(c.strip().replace('|', chr(92) + '|') for c in r)} |" for r in [head, *body[:200]]]
        lines.insert(1, f"|{' --- |' * len(head)}")
        return Parsed("\n".join(lines) + (f"\n\n{len(body) - 200} more rows omitted" if len(body) > 200 else ""))
    return Parsed("\n\n".join("\n".join([f"## {r[0].strip()}", *(f"- {k}: {v.strip()}" for k, v in zip(head[1:], r[1:]) if v.strip())]) for r in body))


def boilerplate_lines(pages: list[list[str]], share: float = 0.6) -> dict[str, int]:
    """Short lines among the first or last two of many pages (of three at least), and how often they stand there."""
    seen: dict[str, int] = {}
    for lines in pages:
        solid = [x for x in lines if x]
        for x in solid[:2] + solid[-2:]:
            seen[x] = seen.get(x, 0) + (3 <= len(x) <= 120)
    return {x: n for x, n in seen.items() if len(pages) >= 3 and n >= max(3, int(share * len(pages)))}


def heading_level(line: str) -> int:
    """The level of a line that reads as a heading by its number, capitals or capitalised words; 0 if it doesn't."""
    words = line.split()
    if not 0 < len(words) <= 10 or line[-1] in ".!?,;:":
        return 0
    if re.match(r"\d+(?:\.\d+)*\.?\s+[A-Z]", line):
        return min(6, 2 + words[0].rstrip(".").count("."))
    return 2 * (line.isupper() or len(words) > 1 and all(w[0].isupper() or len(w) <= 3 for w in words))


def reflow(pages: list[str]) -> str:
    """Pages of running text -> paragraphs: no boilerplate or page numbers, hyphens joined, headings marked."""
    split = [[x.strip() for x in re.sub(r"(\w)-\n(\w)", r"\1\2", p).split("\n")] for p in pages]
    odd = boilerplate_lines(split)
    out, held = [], []
    flush = lambda: (out.append(" ".join(held)), held.clear()) if held else None
    for x in (x for lines in split for x in [*lines, ""]):
        if x in odd or re.fullmatch(r"(?:page )?\d+(?: (?:of|/) \d+)?", x, re.I):
            continue
        heading = heading_level(x)
        if not x or heading or re.match(r"(?:[-*•]|\d+[.)])\s", x):
            flush()
            if heading:
                out.append(f"{'#' * heading} {x}")
            elif x:
                out.append(x)
            continue
        held.append(x)
        if x[-1] in ".!?" and len(" ".join(held)) >= 400:
            flush()
    flush()
    return "\n\n".join(out)


def parse_pdf(data: bytes, source: str = "") -> Parsed:
    try:
        import pypdf
    except ImportError as e:
        raise MissingDependency("pypdf is needed to read PDF files", hint="pip install pypdf") from e
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        if reader.is_encrypted and not reader.decrypt(""):
            raise ParseError(f"{source}: encrypted")
        text = reflow([p.extract_text() or "" for p in reader.pages])
    except pypdf.errors.PdfReadError as e:
        raise ParseError(f"{source}: {e}") from e
    if not text.strip():
        raise ParseError(f"{source}: no text")
    title = str((reader.metadata or {}).get("/Title") or "").strip()
    return Parsed(text, "" if re.match(r"(?i)untitled|microsoft word|document\d*$", title) else title, {}, bool(title))


register_parser("text", (".txt", ".text", ".log", ".rst"), parse_text)
register_parser("markdown", (".md", ".markdown", ".mdown", ".mkd", ".mdx"), parse_markdown)
register_parser("html", (".html", ".htm", ".xhtml"), parse_html)
register_parser("json", (".json", ".jsonl", ".ndjson"), parse_json)
register_parser("csv", (".csv", ".tsv"), parse_csv)
register_parser("pdf", (".pdf",), lambda text, source: parse_pdf(text.encode("latin-1"), source))


def default_title(path: str) -> str:
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return " ".join(w if w.isupper() else w.capitalize() for w in re.sub("[_-]", " ", stem).split())


def parse_bytes(data: bytes, path: str) -> Parsed:
    """A file's document; its title is its own where the format names one, else the file's."""
    name, parser = parser_for(path)
    p = parser(data.decode("latin-1") if name == "pdf" else decode(data, path), path)
    p.title = (p.title if p.authoritative and p.title else "") or default_title(path)
    return p


unescape = html.unescape
