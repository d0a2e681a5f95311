"""Quality scores against a plain version that works on the chunk's text alone."""

import re
from collections import Counter

import pytest

from chunkloom.config import Chunking, Config
from chunkloom.functions import textkit as T
from chunkloom.operators import roles, stages

MD = """# Guide

Some words stand here, and they explain things well. They do (so at length. It goes on.

## Tags

a1; b2; c3; d4; e5; f6

## Steps

3. open it now
4. close it again

| a | b |
| 1 | 2 |

## Code

```python
def f():
    return 1
```

lower case begins this and it ends with nothing
"""


def plain(c, cfg):
    q, k, text = cfg.quality, cfg.chunking, c.content
    body = "\n".join(x for x in text.split("\n") if not re.match(r"\s{0,3}#{1,6}\s", x)).strip()
    lines, words = body.split("\n"), body.split()
    shape, parts = roles.shape_of(text), T.sentences(body)
    kind, role, path = c.content_type, c.semantic_role, list(c.heading_path)
    n, empty = len(words), not body
    edge = ".,;:!?()[]{}\"'`*"
    meaning = [w for w in (T.casefold(w.strip(edge)) for w in words) if w and w not in stages._STOP]
    size = c.size
    if size < k.min_size:
        length = size / k.min_size * 0.6
    elif size > k.max_size:
        length = 0.6 - min((size - k.max_size) / k.max_size, 0.6)
    else:
        length = max(0, 1 - abs(size - k.target_size) / k.target_size * 0.7)
    fences = sum(x.lstrip().startswith(("```", "~~~")) for x in text.split("\n")) % 2 == 1
    rows = [x for x in text.split("\n") if re.fullmatch(r"\s*\|.*\|\s*", x)]
    table = len(rows) >= 2 and not any(re.fullmatch(r"\s*\|?[\s:|-]+\|[\s:|-]*", x) for x in rows[:2])
    number = re.match(r"\s*(\d+)[.)]\s", lines[0])
    cut_list = bool(c.extra.block_split and number and number[1] not in ("0", "1"))
    prose = not empty and kind not in ("table", "list", "code", "heading", "metadata")
    last = lines[-1]
    open_end = prose and not re.match(r"(- |\* |\+ |\||>|```|~~~|(?:\d+|[a-zA-Z])[.)]\s)", last.strip()) and not T.ends_sentence(last)
    low = prose and kind == "text" and body[:1].islower()
    stack, balanced = [], True
    for x in text:
        if x in "([{":
            stack.append(x)
        elif x in ")]}":
            balanced &= bool(stack) and stack.pop() == {")": "(", "]": "[", "}": "{"}[x]
            if not balanced:
                break
    balanced &= not stack
    shift = False
    if kind == "text" and len(parts) >= 6:
        third = max(2, len(parts) // 3)
        a, b = ({w for w in (T.casefold(x.strip(edge)) for x in " ".join(p).split() if len(x) > 3 and T.casefold(x) not in stages._STOP)} for p in (parts[:third], parts[-third:]))
        shift = min(len(a), len(b)) >= 5 and len(a & b) < 0.05 * min(len(a), len(b))
    coherence = 1 - 0.3 * fences - 0.2 * bool(c.extra.code_split) - 0.25 * table - 0.15 * cut_list - 0.3 * open_end - 0.15 * low - 0.1 * (not balanced) - 0.1 * shift
    context = (0.45 + 0.05 * min(len(path), 3)) * bool(path) + 0.2 * bool(c.title) + 0.1 * bool(c.source) + 0.1 * bool(c.context_prefix) + 0.1 * bool(c.section and T.casefold(c.section)[:40] in T.casefold(text))
    context = min(1, context)
    bare = n < q.low_context_word_threshold and not path
    info = 0.0
    if n:
        info = 0.4 * min(len(meaning) / n / 0.6, 1) + 0.3 * len(set(meaning)) / max(1, len(meaning)) + 0.15 * min(sum(x.isalnum() for x in body) / len(body) / 0.7, 1) + 0.15 * min(shape.verb_ratio / 0.5, 1)
    terms = shape.is_terms and shape.fenced < 0.4
    few, orphan = n < q.min_knowledge_words, role in roles.NEEDS_PARENT and not path
    auxiliary = role in roles.AUXILIARY_ROLES
    useful = 1 - 0.45 * few - 0.3 * orphan - 0.2 * (not parts and kind not in ("code", "table", "list"))
    retrieval = 0 if empty else 0.1 if role == "navigation" else 0.15 if auxiliary else 0.2 if terms else useful
    normal = not empty and not auxiliary and not terms
    segments = [x for x in map(str.strip, re.split(r"[;\n•]", body)) if x]
    heads = Counter(T.casefold(w[0]) for w in (re.sub(r"[^\w\s]", " ", x).split() for x in segments) if w)
    alias = max(heads.values(), default=0) / len(segments) if len(segments) >= 5 else 0
    flags = [name for name, on in [
        ("too_short", size < k.min_size), ("too_long", size > k.max_size), ("oversized", size > k.max_size), ("code_split", fences or c.extra.code_split), ("fragmented_table", table), ("fragmented_list", cut_list),
        ("broken_sentence", open_end or low), ("mixed_topics", shift), ("low_context", bare or context < 0.35), ("low_information", n < 8 or info < 0.35 or normal and few), ("heading_only", empty),
        ("metadata_only", not empty and role in ("document_meta", "navigation")), ("keyword_heavy", not empty and (role == "retrieval_terms" or terms and not auxiliary)), ("alias_heavy", not empty and not auxiliary and terms and alias >= 0.55), ("orphaned_context", normal and orphan),
    ] if on]
    context *= 0.5 if bare else 1
    clamp = lambda x: max(0.0, min(1.0, x))
    parts_ = [retrieval, clamp(info), clamp(coherence), context, length]
    total = sum(w * x for w, x in zip((0.3, 0.25, 0.2, 0.15, 0.1), parts_))
    return [total, length, clamp(coherence), context, clamp(info), retrieval], flags


@pytest.mark.parametrize("strategy", ["sentence", "semantic", "structural"])
def test_scores_and_flags(spark, sf, strategy):
    cfg = Config(chunking=Chunking(strategy=strategy, target_size=60, min_size=20, max_size=90, overlap=0))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).selectExpr("cast(doc_id as string) document_id", "if(doc_id % 2 = 0, '', 'T') title", "source", "text content")
    docs = docs.union(spark.createDataFrame([("m", "", "", MD), ("e", "", "", "")], "document_id string, title string, source string, content string"))
    scored = stages.score(stages.enrich(stages.chunks_of(stages.process(docs, cfg), cfg), cfg), cfg).collect()
    assert len(scored) > 100
    for c in scored:
        want, flags = plain(c, cfg)
        q = c.quality
        got = [q.quality_score, q.length_score, q.coherence_score, q.context_score, q.information_score, q.retrieval_score]
        assert all(abs(a - b) < 2e-4 for a, b in zip(got, want)), (c.id, got, want)
        assert list(q.flags) == flags, (c.id, c.content)
