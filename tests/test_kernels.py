"""The sequential kernels against hand-made cases and invariants."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.config import Chunking, Cleaning, Config
from chunkloom.errors import ConfigError
from chunkloom.functions import textkit as T
from chunkloom.operators.blocks import analyze
from chunkloom.operators.chunkers import chunk_text, content_type, split_code, split_table
from chunkloom.operators.roles import classify, extract_terms, heading_intent
from chunkloom.operators.stages import kernel
from chunkloom.sources import parsers as P

import pytest

MD = """# Guide

Some words stand here. They explain things.

## Tools

- hammer
- saw

```python
def a():
    return 1
```

| k | v |
|---|---|
| a | 1 |

> quoted

### Deep

Last paragraph.
"""


def test_blocks_and_paths():
    b = analyze(MD)
    assert [x.type for x in b] == ["title", "paragraph", "heading", "list", "code", "table", "quote", "heading", "paragraph"]
    assert b[-1].path == ["Guide", "Tools", "Deep"]
    assert b[3].items == 2 and b[5].has_header and b[4].closed and b[4].language == "python"
    for x in b:
        if not x.is_heading:
            assert MD[x.start : x.end].rstrip("\n") == x.text


def test_unclosed_fence_runs_to_the_end():
    b = analyze("```\na\n\n# no heading")
    assert len(b) == 1 and b[0].type == "code" and not b[0].closed


@given(st.text(alphabet="ab .#-|>`\n1)", max_size=120))
@settings(max_examples=150, deadline=None)
def test_analysis_and_chunking_take_any_text(text):
    analyze(text)
    for strategy in ("semantic", "structural", "recursive", "sentence", "code"):
        for d in chunk_text(text, Chunking(strategy=strategy, target_size=12, min_size=3, max_size=20, overlap=4)):
            assert d.text.strip()


def test_sentences():
    assert T.sentences("Dr. Smith paid 3.5 dollars. He left!  Done") == ["Dr. Smith paid 3.5 dollars.", "He left!", "Done"]
    assert T.sentences("- one. two\n- three") == ["- one. two", "- three"]
    assert T.sentences(" \n") == []


@pytest.mark.parametrize("strategy", ["semantic", "structural", "recursive", "sentence"])
def test_no_word_is_lost_and_sizes_hold(strategy):
    text = "# T\n\n" + "\n\n".join(" ".join(f"Sentence {i} of part {j} is here." for i in range(20)) for j in range(5))
    d = chunk_text(text, Chunking(strategy=strategy, target_size=60, min_size=10, max_size=90, overlap=0))
    words = re.findall(r"\w+", " ".join(re.sub(r"(?m)^# T$", "", x.text) for x in d))
    assert words == re.findall(r"\w+", text[3:])
    assert max(T.count_tokens(x.text) for x in d) <= 90


def test_overlap_repeats_only_split_pieces():
    text = "# T\n\n" + " ".join(f"Sentence number {i} is here now." for i in range(60))
    d = chunk_text(text, Chunking(target_size=60, min_size=10, max_size=100, overlap=15))
    assert d[0].overlap_chars == 0 and all(x.overlap_chars for x in d[1:])


def test_terms_become_metadata():
    d = chunk_text("# A\n\nThis is knowledge that is explained in words.\n\n## Keywords\n\nalpha; beta; gamma; delta; epsilon")
    assert len(d) == 1 and d[0].terms["keywords"][1:] == ["alpha", "beta", "gamma", "delta", "epsilon"]
    only = chunk_text("## Tags\n\na1; b2; c3; d4; e5")
    assert len(only) == 1 and only[0].terms


def test_roles():
    assert heading_intent("3.1 Search Aliases") == ("retrieval_terms", "aliases")
    assert classify("", None).confidence == 0
    assert classify("1. Open the lid and it is done\n2. Close it as is\n3. It was shut").role == "procedure"
    assert classify("What is a?\nWhat is b?\nWhat is c?").field == "questions"
    assert extract_terms("a; B; b; c") == ["a", "B", "c"]


def test_splitters():
    size = T.count_tokens
    assert all(p.startswith("| a |\n|---|") for p in split_table("| a |\n|---|\n" + "\n".join(f"| row {i} |" for i in range(20)), size, 20))
    parts = split_code("```python\n" + "\n".join(f"def f{i}():\n    return {i}\n" for i in range(9)) + "```", size, 30, None)
    assert len(parts) > 1 and all(p.startswith("```python\n") and p.endswith("```") for p in parts)
    assert content_type([("code", 50), ("table", 50)]) == "mixed" and content_type([("heading", 3)]) == "heading"


def test_cleaning_keeps_code():
    assert T.clean("a  b​\n\n\n\n```\nx  y\n```\n12", Cleaning()) == "a b\n\n```\nx  y\n```\n12"
    text = "\n\n\n".join(f"Header line\n\npart {i}" for i in range(4))
    assert "Header" not in T.clean(text, Cleaning(remove_headers=True))


def test_kernel_reports_errors_as_values():
    assert kernel(None, Config())["chunks"] == []


def test_parsers():
    assert P.parse_markdown("---\ntitle: X\n---\nHead\n====\ntext").title == "X"
    assert P.parse_markdown("Head\n====\ntext").content.startswith("# Head")
    title, md, meta = P.html_to_markdown('<title>T</title><meta name="author" content="A"><nav><form>no</form></nav><h1>H</h1><ul><li>a<ul><li>b</li></ul></li></ul><pre><code class="language-py">x  = 1\n  y</code></pre><table><tr><th>a<th>b<tr><td>1</table>')
    assert title == "T" and meta["author"] == "A" and "no" not in md
    assert "  - b" in md and "```py\nx  = 1\n  y\n```" in md and "| 1 | |" in md
    assert P.parse_json('[{"title": "A", "x": 1}, {"name": "B"}]').content.startswith("## A\n- title: A")
    with pytest.raises(P.ParseError, match="line 2"):
        P.load_json('{"a": 1}\nnope\n')
    assert P.parse_csv("name;role\nAnn;x\nBob;y\n").content == "## Ann\n- role: x\n\n## Bob\n- role: y"
    assert P.parse_csv("a,b\n1,2\n").content.startswith("| a | b |")
    assert P.decode("é".encode("cp1252")) == "é" and P.default_title("/x/my_file-API.md") == "My File API"
    with pytest.raises(P.ParseError):
        P.decode(b"a\0b")
    with pytest.raises(P.UnsupportedFormat):
        P.parser_for("x.zip")
    pages = [f"Top line\nInter-\nnational text {i} goes on.\n{i}" for i in range(4)]
    assert "International" in P.reflow(pages) and "Top line" not in P.reflow(pages)


def test_config():
    assert Config.of({"chunking": {"size": 300, "min_size": 10, "overlap": 20}}).chunking.target_size == 300
    for bad in ({"chunking": {"nope": 1}}, {"x": {}}, {"chunking": {"min_size": 900}}):
        with pytest.raises(ConfigError):
            Config.of(bad)


def test_words_are_counted_once_and_the_cache_is_bounded(monkeypatch):
    from chunkloom.functions import textkit as T

    plain = lambda t: sum((len(T.CJK.findall(w)) if not w.isascii() else 0) + T.subwords(len(w) - (len(T.CJK.findall(w)) if not w.isascii() else 0)) if len(w) > 6 else 1 for w in T.WORD.findall(t))
    texts = ["", " ", "_", "x_", "abcdefgh_", "abcdefgh,", "abcdefgh\x1c.,", "a,b c;d", "中文字符很长的一段话", "straße, Straßenbahnhaltestelle", "x" * 100, "a　b\x85c", "²³ٳ Ⅷ"]
    assert [T.count_tokens(t) for t in texts] == [plain(t) for t in texts]
    seen = []
    words = T.Words(lambda w: seen.append(w) or len(w), most=2)
    assert [words[w] for w in ("a", "a", "bb", "ccc", "d" * 40, "d" * 40)] == [1, 1, 2, 3, 40, 40]
    assert seen == ["a", "bb", "ccc", "d" * 40, "d" * 40] and len(words) <= 2
