"""Sequential text functions that column expressions can't state: sentences, white space, tokens."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from chunkloom.errors import MissingDependency

_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = re.compile(r"\w+|[^\w\s]")
ALNUM = re.compile(r"[^\W_]+")
CJK = re.compile("[\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff]")
MARKER = re.compile(r"\s*(?:[-*+•]|[a-zA-Z][.)]|\d+[.)])\s+")
_STOP = re.compile("[.!?][)\\]\"'’”]*(?=\\s|$)")
_SPACES = re.compile("[\t \u00a0\u2000-\u200a]+")
_TITLES = "dr jr mr mrs ms prof sr st"
_LATIN = "al approx cf co e.g eq etc fig i.e inc ltd no resp vs"
_DATES = "apr aug dec feb fri jan jul jun mar mon nov oct sat sep sept sun thu tue wed a.m p.m"
_DEGREES = "b.sc m.sc ph.d u.k u.s"
ABBREVIATIONS = frozenset(" ".join((_TITLES, _LATIN, _DATES, _DEGREES)).split())
_LONGEST = max(map(len, ABBREVIATIONS))
_BREAK = re.compile(r"[\s\[(\"']")
_ACRONYM = re.compile(r"(?:[a-zA-Z]\.)+[a-zA-Z]?")
_SHORT = re.compile(r"(?:^|[\s\[(\"'])(?:[a-z]|" + "|".join(map(re.escape, sorted(ABBREVIATIONS))) + r")\Z", re.I)
_AFTER = re.compile(r"\s+(\S)")
#: Typographic signs and what they become.
QUOTES = {ord(a): b for chars, b in (("‘’‚‛′", "'"), ("“”„‟″«»", '"'), ("–—−", "-"), ("…", "...")) for a in chars}


class Words(dict):
    """What ``of`` makes of a word: short ones are remembered, as long as there are at most ``most``."""

    def __init__(self, of: Callable, most: int = 1 << 17) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        out = self.of(word)
        if len(word) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


def casefold(text: str) -> str:
    """The engine's folding: lower case, with ß as ss; the same in SQL, unlike full case folding."""
    return text.lower().replace("ß", "ss")


def subwords(n: int) -> int:
    return 0 if n <= 0 else 1 if n <= 6 else 1 + -(-(n - 6) // 4)


def count_tokens(text: str) -> int:
    """Estimated subword tokens: long words count in parts, ideographs of a long word singly. No token holds white space."""
    return sum(map(_COUNTS.__getitem__, text.split()))


def _count(text: str) -> int:
    if text.isascii():
        word = text if text.isalnum() else text[:-1]
        if word.isalnum():  # a word, or one and a sign behind it
            return subwords(len(word)) + len(WORD.findall(text[len(word) :])) if text[-1] != "_" else subwords(len(text))
    tokens = WORD.findall(text)
    total = len(tokens)
    for token in [t for t in tokens if len(t) > 6]:
        wide = 0 if token.isascii() else len(CJK.findall(token))
        total += wide + subwords(len(token) - wide) - 1
    return total


_COUNTS = Words(_count)


@lru_cache
def encoding(path: str):
    """The byte-level BPE of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def tokenizer(spec: str = "heuristic") -> Callable[[str], int]:
    """What counts tokens: the estimate, or ``tiktoken:`` and a rank file (or the name of an installed encoding)."""
    if spec in ("", "default", "heuristic", "simple"):
        return count_tokens
    kind, _, name = spec.partition(":")
    if kind != "tiktoken":
        raise MissingDependency(f"unknown tokenizer {spec}", hint="heuristic, or tiktoken:<rank file>")
    try:
        import tiktoken

        enc = encoding(name) if "/" in name else tiktoken.get_encoding(name or "cl100k_base")
    except (ImportError, OSError, ValueError) as e:
        raise MissingDependency(f"tokenizer {spec}: {e}") from e
    return lambda text: len(enc.encode_ordinary(text))


def measure(text: str, unit: str, spec: str = "heuristic") -> int:
    return len(text) if unit == "characters" else len(text.split()) if unit == "words" else tokenizer(spec)(text)


def _shortened(text: str, dot: int) -> bool:
    """Whether the full stop at ``dot`` ends an abbreviation, an initial or a dotted acronym."""
    if dot > _LONGEST and text[dot - _LONGEST - 1 : dot].isalpha():
        return False
    if _SHORT.search(text, max(0, dot - _LONGEST - 1), dot):
        return True
    start = dot
    if "." in text[max(0, dot - 2) : dot]:
        while start and (text[start - 1] == "." or (text[start - 1].isascii() and text[start - 1].isalpha())):
            start -= 1
    return start < dot and (not start or _BREAK.match(text, start - 1) is not None) and _ACRONYM.fullmatch(text, start, dot) is not None


def _prose_sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in _STOP.finditer(text):
        at, end = m.span()
        if text[at] == ".":
            # a stop has white space behind it, or nothing
            after = text[end + 1 : end + 2]
            if after.isspace():
                after = m[1] if (m := _AFTER.match(text, end)) else ""
            if (after and unicodedata.category(after) == "Ll") or _shortened(text, at):
                continue
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def sentences(text: str) -> list[str]:
    """Sentences in order; every list item and quoted line is one of its own."""
    return list(_known_sentences(text)) if len(text) <= 1 << 14 else _sentences(text)


def _sentences(text: str) -> list[str]:
    groups: list[tuple[bool, bool, list[str]]] = []
    for line in text.split("\n"):
        item = MARKER.match(line) is not None
        alone = item or line.lstrip().startswith(">")
        if alone or not groups or groups[-1][1]:
            groups.append((item, alone, [line]))
        else:
            groups[-1][2].append(line)
    out: list[str] = []
    for item, _, lines in groups:
        whole = "\n".join(lines)
        out += [whole] if item else _prose_sentences(whole)
    return [s for s in (x.strip() for x in out) if s]


#: The chunks of a document are taken apart for the overlap and again to be measured.
_known_sentences = lru_cache(64)(_sentences)


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n+", text)) if p]


def ends_sentence(text: str) -> bool:
    t = text.rstrip()
    return not t or t[-1] in ".!?:;。！？" or (t[-1] in ")]}\"'`”’" and t[-2:-1] in (".", "!", "?"))


def tidy_spaces(text: str) -> str:
    """Inline runs become one space; indents stay where they mean something (code, lists, marker lines)."""
    out, listing = [], False
    for raw in re.sub(r"\r\n?", "\n", text).split("\n"):
        rest = raw.lstrip("\t \u00a0")
        body = _SPACES.sub(" ", rest).rstrip()
        if not body:
            out.append("")
            listing = False
            continue
        indent = raw[: len(raw) - len(rest)].replace("\t", "    ")
        meant = listing or len(indent) >= 4 or body[0] in "-*+>|" or re.match(r"\d+[.)]\s", body)
        out.append((indent if meant else "") + body)
        listing = MARKER.match(body) is not None or (listing and bool(indent))
    return "\n".join(out).strip()


def alnum_share(text: str) -> float:
    return sum(map(_ALNUMS.__getitem__, text.split())) / len(text) if text else 0.0


_ALNUMS = Words(lambda word: sum(map(len, ALNUM.findall(word))))


def slug(value: str, most: int = 60) -> str:
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:most].strip("-")


_FENCED = re.compile(r"(?P<lead>^|\n)(?P<mark>```|~~~)[^\n]*\n.*?(?:\n(?P=mark)[ \t]*(?=\n|$)|\Z)", re.S)
_URL = re.compile(r"(?:https?://|www\.)\S+")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_LINK = r"\[[^\]]+\]\([^)]*\)"
NAVIGATION = [
    r"\s*(?:next|previous|home|skip to (?:main )?content|back to top)\s*[|>»]*\s*",
    r"\s*(?:breadcrumbs?|contents|menu|navigation|table of contents)\s*",
    r"\s*(?:cookies? policy|follow us|subscribe|share (?:on|this))\b.*",
    rf"\s*(?:{_LINK}\s*[|·•]\s*){{2,}}{_LINK}\s*",
]
_NAVIGATION = [re.compile(p, re.I) for p in NAVIGATION]


def drop_repeated_lines(text: str, headers: bool, footers: bool, share: float, least: int) -> str:
    """Takes out short lines that open or close many sections (parts between double blank lines)."""
    parts = re.split(r"\n\s*\n\s*\n|\f", text)
    parts = parts if len(parts) >= least else [text]
    seen: dict[str, int] = {}
    for part in parts:
        lines = [x for x in map(str.strip, part.split("\n")) if x]
        for line in lines[:2] * headers + lines[-2:] * footers:
            if 3 <= len(line) <= 120 and line[0] != "#":
                seen[line] = seen.get(line, 0) + 1
    limit = max(least, int(len(parts) * share))
    odd = {x for x, n in seen.items() if n >= limit}
    return "\n".join(x for x in text.split("\n") if x.strip() not in odd) if odd else text


def clean(text: str, cfg) -> str:
    """All the enabled steps of ``cfg`` (a config.Cleaning) in their fixed order; fenced code stays as it was."""
    if not text or not cfg.enabled:
        return text or ""
    kept: list[str] = []
    if cfg.preserve_code_blocks:

        def stash(m: re.Match) -> str:
            kept.append(m.group().lstrip("\n"))
            return f"{m['lead']}\ue000{len(kept) - 1}\ue001"

        text = _FENCED.sub(stash, text) if "```" in text or "~~~" in text else text
    text = _INVISIBLE.sub("", re.sub(r"\r\n?", "\n", text))
    if cfg.normalize_unicode:
        text = unicodedata.normalize(cfg.unicode_form, text)
    if cfg.normalize_quotes:
        text = text.translate(QUOTES)
    if cfg.remove_navigation:
        text = "\n".join(x for x in text.split("\n") if not any(p.fullmatch(x) for p in _NAVIGATION))
    if cfg.remove_headers or cfg.remove_footers:
        text = drop_repeated_lines(text, cfg.remove_headers, cfg.remove_footers, cfg.repeated_line_threshold, cfg.min_repeats_for_boilerplate)
    if cfg.remove_urls:
        text = _URL.sub("", text)
    if cfg.normalize_whitespace:
        text = tidy_spaces(text)
    if cfg.collapse_blank_lines:
        text = re.sub("\n{3,}", "\n\n", text)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text).strip()
