"""The document stages on Spark: one narrow pass of the kernel, then native corpus stages.

The kernel gives one row per document with its blocks and its chunks, so it runs once for all that is made
of them; sizes, ids, context, duplicates, scores and reports are expressions on its output.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import Config
from chunkloom.functions import exprs as X
from chunkloom.functions import textkit as T
from chunkloom.functions import udfs as U
from chunkloom.operators import corpus
from chunkloom.operators.blocks import analyze
from chunkloom.operators.chunkers import chunk_blocks
from chunkloom.progress import Progress, Silent
from chunkloom.operators.roles import AUXILIARY_ROLES, NEEDS_PARENT, shape_of

FIELDS = ("keywords", "tags", "aliases", "entities", "related_concepts", "questions")

_BLOCK = pa.struct([
    ("block", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("heading_path", pa.list_(pa.string())), ("language", pa.string()),
    ("first_line", pa.int32()), ("last_line", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("items", pa.int32()), ("rows", pa.int32()), ("has_header", pa.bool_()), ("fenced", pa.bool_()), ("closed", pa.bool_()),
])
_EXTRA = pa.struct([
    ("block_types", pa.list_(pa.string())), ("merged_sections", pa.list_(pa.string())), ("part_index", pa.int32()), ("part_total", pa.int32()),
    ("block_split", pa.bool_()), ("code_split", pa.bool_()), ("heading_only", pa.bool_()),
])
_MEASURES = pa.struct([
    ("first", pa.string()), ("last", pa.string()), ("is_terms", pa.bool_()), ("fenced", pa.float64()), ("verb_ratio", pa.float64()), ("sentences", pa.int32()), ("brackets", pa.bool_()), ("topic_shift", pa.bool_()),
    ("words", pa.int32()), ("meaningful", pa.int32()), ("distinct", pa.int32()), ("alnum", pa.float64()), ("alias", pa.float64()),
])
_CHUNK = pa.struct([
    ("chunk_index", pa.int32()), ("content", pa.string()), ("heading_path", pa.list_(pa.string())), ("content_type", pa.string()), ("semantic_role", pa.string()), ("language", pa.string()),
    ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("overlap_prefix_chars", pa.int32()), ("sentence_count", pa.int32()), ("size", pa.int32()), ("word_count", pa.int32()), ("token_count", pa.int32()),
    ("retrieval", pa.struct([(f, pa.list_(pa.string())) for f in FIELDS])), ("extra", _EXTRA), ("measures", _MEASURES),
])
_OUT = [("strategy", pa.string()), ("content", pa.string()), ("characters", pa.int64()), ("error", pa.string()), ("n_blocks", pa.int32()), ("blocks", pa.list_(_BLOCK)), ("chunks", pa.list_(_CHUNK))]


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_struct(t):
        return f"struct<{', '.join(f'{f.name}: {_ddl(f.type)}' for f in t)}>"
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    return {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}.get(t, "string")


SCHEMA = "document_id string, title string, source string, " + ", ".join(f"{n} {_ddl(t)}" for n, t in _OUT)

_BRACKETS = T.re.compile(r"[(\[{)\]}]")
_CLOSE = {")": "(", "]": "[", "}": "{"}
_STOP = frozenset("a an and are as at be but by can could did do does for from had has have he if in into is it its may might must no not of on or over shall should than that the then these this those to under was were which who whom will with would".split())


_EDGES = ".,;:!?()[]{}\"'`*"
#: The folded word without signs at its ends, empty for stop words; as content of a sentence, None for stop words and short ones.
_MEANING = T.Words(lambda x: "" if (w := T.casefold(x.strip(_EDGES))) in _STOP else w)
_CONTENT = T.Words(lambda x: T.casefold(x.strip(_EDGES)) if len(x) > 3 and T.casefold(x) not in _STOP else None)


def brackets_balanced(text: str) -> bool:
    open_: list[str] = []
    for c in _BRACKETS.findall(text):
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() != _CLOSE[c]:
            return False
    return not open_


def topic_shift(parts: list[str]) -> bool:
    """Hardly any content word in common between the first and the last third of at least six sentences."""
    if len(parts) < 6:
        return False
    n = max(2, len(parts) // 3)
    a, b = (set(map(_CONTENT.__getitem__, " ".join(p).split())) - {None} for p in (parts[:n], parts[-n:]))
    return min(len(a), len(b)) >= 5 and len(a & b) < 0.05 * min(len(a), len(b))


def alias_share(body: str) -> float:
    """The share of segments that begin with the most frequent first word; 0 below five segments."""
    segments = [x for x in map(str.strip, T.re.split(r"[;\n•]", body)) if x]
    if len(segments) < 5:
        return 0.0
    heads = Counter(T.casefold(m[0]) for m in (T.re.search(r"\w+", x) for x in segments) if m)
    return max(heads.values(), default=0) / len(segments)


def _measures(text: str, kind: str, parts: list[str]) -> dict:
    """What score reads of a chunk; ``parts`` are its sentences."""
    body = "\n".join(x for x in text.split("\n") if not T.re.match(r"\s{0,3}#{1,6}\s", x)).strip()
    s, parts = shape_of(text), parts if body == text else T.sentences(body)
    words = body.split()
    meaning = list(filter(None, map(_MEANING.__getitem__, words)))
    return {"words": len(words), "meaningful": len(meaning), "distinct": len(set(meaning)), "alnum": T.alnum_share(body), "alias": alias_share(body),
        "first": body.split("\n", 1)[0], "last": body.rsplit("\n", 1)[-1], "is_terms": s.is_terms, "fenced": s.fenced, "verb_ratio": s.verb_ratio, "sentences": len(parts), "brackets": brackets_balanced(text), "topic_shift": kind == "text" and topic_shift(parts)}


def kernel(text: str | None, cfg: Config, with_blocks: bool = True, with_measures: bool = True) -> dict:
    """What the stages up to chunking make of one document; an error is a value, so one bad document stops nothing."""
    unit, spec = cfg.chunking.unit, cfg.chunking.tokenizer
    raw = text or ""
    out = {"strategy": None, "content": None, "characters": len(raw), "error": None, "n_blocks": 0, "blocks": [], "chunks": []}
    try:
        out["content"] = content = T.clean(raw, cfg.cleaning)
        blocks = analyze(content)
        out["strategy"], drafts = chunk_blocks(blocks, cfg.chunking, cfg.semantics)
    except Exception as e:  # any document at all may be the one that breaks a rule
        return out | {"error": f"{type(e).__name__}: {e}"}
    out["blocks"] = [{
        "block": i, "type": b.type, "text": b.text, "level": b.level, "heading_path": b.path, "language": b.language, "first_line": b.first_line, "last_line": b.last_line,
        "start_offset": b.start, "end_offset": b.end, "items": b.items, "rows": b.rows, "has_header": b.has_header, "fenced": b.fenced, "closed": b.closed,
    } for i, b in enumerate(blocks)] if with_blocks else []
    out["n_blocks"] = len(blocks)
    for i, d in enumerate(drafts):
        t = d.text.strip()
        parts, tokens = T.sentences(t), T.measure(t, "tokens", spec)
        out["chunks"].append({
            "chunk_index": i, "content": t, "heading_path": d.path, "content_type": d.content_type, "semantic_role": d.role, "language": d.language, "start_offset": d.start, "end_offset": d.end,
            "overlap_prefix_chars": d.overlap_chars, "sentence_count": len(parts), "size": tokens if unit == "tokens" else T.measure(t, unit, spec), "word_count": len(t.split()), "token_count": tokens,
            "retrieval": {f: d.terms.get(f, [])[: cfg.semantics.max_terms_per_field] for f in FIELDS},
            "extra": {k: getattr(d, k) for k in ("block_types", "merged_sections", "part_index", "part_total", "block_split", "code_split", "heading_only")},
            "measures": _measures(t, d.content_type, parts) if with_measures else None,
        })
    return out


def process(documents: DataFrame, cfg: Config | None = None, with_blocks: bool = True, with_measures: bool = True) -> DataFrame:
    """``(document_id, title, source, content)`` -> a row per document with its cleaned text, blocks and chunks.

    Null texts are empty documents; other columns are ignored. Blocks, which only the audit reads, hold the
    text once more and may be left out; so may the measures of chunks, which only score reads.
    """
    cfg = cfg or Config()
    d = documents.select(F.col("document_id").cast("string"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.col("content").cast("string"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [kernel(t, cfg, with_blocks, with_measures) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array([r[n] for r in rows], t) for n, t in _OUT)], ["document_id", "title", "source", *(n for n, _ in _OUT)])

    return d.mapInArrow(run, SCHEMA)


def blocks_of(processed: DataFrame) -> DataFrame:
    return processed.select("document_id", F.inline("blocks"))


def chunks_of(processed: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The chunk table: a row per chunk of the kernel, with its id and place."""
    c = (cfg or Config()).chunking
    rows = processed.select("document_id", "title", "source", "strategy", F.size("chunks").alias("total_chunks"), F.inline("chunks"))
    section = F.try_element_at("heading_path", F.lit(-1))
    return rows.withColumns({
        "id": X.chunk_id("document_id", "chunk_index"), "section": section, "parent_section": F.when(F.size("heading_path") > 1, F.try_element_at("heading_path", F.lit(-2))),
        "unit": F.lit(c.unit), "char_count": F.length("content"),
    })


def enrich(chunks: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Neighbours, parents and context prefix; with prepend_context_to_content sizes are counted anew."""
    cfg = cfg or Config()
    x = cfg.context
    out = corpus.neighbours(chunks, "document_id", "chunk_index", "id")
    out = corpus.parents(out, "document_id", "chunk_index", "heading_path", x.parent_level)
    none = F.lit("")
    prefix = X.context_prefix(F.col("title") if x.include_document_title else none, F.col("heading_path") if x.include_heading_path else F.array().cast("array<string>"), F.col("source") if x.include_source else none, x.heading_separator)
    out = out.withColumn("context_prefix", prefix if x.add_prefix else F.lit(None).cast("string"))
    if x.add_prefix and x.prepend_context_to_content:
        out = out.withColumn("content", F.when(F.col("context_prefix") != "", F.concat("context_prefix", F.lit("\n\n"), "content")).otherwise(F.col("content")))
        tokens = X.count_tokens("content") if cfg.chunking.tokenizer == "heuristic" else U.tokenizer_count("content", cfg.chunking.tokenizer)
        out = out.withColumns({"token_count": tokens.cast("int"), "char_count": F.length("content"), "word_count": X.count_words("content")})
        out = out.withColumn("size", F.col({"characters": "char_count", "words": "word_count"}.get(cfg.chunking.unit, "token_count")))
    return out


def deduplicate(chunks: DataFrame, cfg: Config | None = None) -> DataFrame:
    """``duplicate_of``, ``duplicate_kind`` and ``similarity``; with action drop the duplicates are gone.

    Exact copies first, by hash; near copies among what is left, by banded MinHash and exact Jaccard. The
    order of chunks is that of (document_id, chunk_index).
    """
    d = (cfg or Config()).deduplication
    names = {"duplicate_kind": F.when(F.col("duplicate_of").isNotNull(), "duplicate"), "similarity": F.when(F.col("duplicate_of").isNotNull(), F.lit(1.0))}
    if not d.enabled:
        none = {"duplicate_of": F.lit(None).cast("string"), "duplicate_kind": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")}
        return chunks.withColumns(none)
    out = corpus.exact_duplicates(chunks, "id", "content", ["document_id", "chunk_index"], ["document_id"] if d.scope == "document" else None, d.min_length).withColumns(names)
    if d.method == "minhash":
        out = corpus.cut(out)
        live = out.where(F.col("duplicate_of").isNull() & (F.length(F.trim("content")) >= d.min_length))
        key = F.struct("document_id", "chunk_index", "id")
        pairs = corpus.minhash_pairs(live.withColumn("_key", key), "_key", "content", d.similarity_threshold, d.shingle_size, d.num_perm)
        if d.scope == "document":
            pairs = pairs.where(F.col("a.document_id") == F.col("b.document_id"))
        near = corpus.greedy_originals(pairs).select(F.col("dup.id").alias("id"), F.col("original.id").alias("_of"), F.col("similarity").alias("_sim"))
        out = out.join(near, "id", "left")
        out = out.withColumns({"duplicate_kind": F.coalesce("duplicate_kind", F.when(F.col("_of").isNotNull(), "near_duplicate")), "similarity": F.coalesce("similarity", "_sim"), "duplicate_of": F.coalesce("duplicate_of", "_of")}).drop("_of", "_sim")
    return out.where("duplicate_of is null") if d.action == "drop" else out


def _flag(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))


def score(chunks: DataFrame, cfg: Config | None = None) -> DataFrame:
    """``quality``: five scores, their weighted sum and the flags, from the kernel's measures and native expressions."""
    cfg = cfg or Config()
    q, c = cfg.quality, cfg.chunking
    m = F.col("measures")
    # the body has no white space at its ends: if it is empty, so is its first line
    first, last, kind, role = m["first"], m["last"], F.col("content_type"), F.col("semantic_role")
    n = m["words"]
    empty = first == ""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    minus = lambda condition, x: F.when(F.coalesce(condition, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))

    length = X.length_score("size", c.min_size, c.target_size, c.max_size)
    fences, table, cut_list = ~X.balanced_fences("content"), X.broken_table("content"), F.col("extra")["block_split"] & X.broken_list(first)
    prose = ~empty & ~kind.isin("table", "list", "code", "heading", "metadata")
    open_end = prose & ~F.trim(last).rlike(r"^(- |\* |\+ |\||>|```|~~~|(?:\d+|[a-zA-Z])[.)]\s)") & ~X.ends_sentence(last)
    low_start = prose & (kind == "text") & X.starts_lower(first)
    shift = (kind == "text") & m["topic_shift"] & (m["sentences"] > 5)
    coherence = unit(1.0 - minus(fences, 0.3) - minus(F.col("extra")["code_split"], 0.2) - minus(table, 0.25) - minus(cut_list, 0.15) - minus(open_end, 0.3) - minus(low_start, 0.15) - minus(~m["brackets"], 0.1) - minus(shift, 0.1))

    path, has = F.col("heading_path"), lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    named = F.coalesce(F.contains(X.casefold("content"), F.substring(X.casefold(F.coalesce("section", F.lit(""))), 1, 40)) & has("section"), F.lit(False))
    context = F.when(F.size(path) > 0, 0.45 + F.least(F.size(path), F.lit(3)) * 0.05).otherwise(0.0) + minus(has("title"), 0.2) + minus(has("source"), 0.1) + minus(has("context_prefix"), 0.1) + minus(named, 0.1)
    context = F.least(F.lit(1.0), context)
    bare = (n < q.low_context_word_threshold) & (F.size(path) == 0)
    some = F.greatest(m["meaningful"], F.lit(1))
    info = 0.4 * F.least(m["meaningful"] / F.greatest(n, F.lit(1)) / 0.6, F.lit(1.0)) + 0.3 * m["distinct"] / some + 0.15 * F.least(m["alnum"] / 0.7, F.lit(1.0)) + 0.15 * F.least(m["verb_ratio"] / 0.5, F.lit(1.0))
    info = F.when(n == 0, F.lit(0.0)).otherwise(unit(info))
    terms = m["is_terms"] & (m["fenced"] < 0.4)
    few, orphan = n < q.min_knowledge_words, role.isin(*NEEDS_PARENT) & (F.size(path) == 0)
    useful = unit(1.0 - minus(few, 0.45) - minus(orphan, 0.3) - minus((m["sentences"] == 0) & ~kind.isin("code", "table", "list"), 0.2))
    auxiliary = role.isin(*AUXILIARY_ROLES)
    retrieval = F.when(empty, 0.0).when(role == "navigation", 0.1).when(auxiliary, 0.15).when(terms, 0.2).otherwise(useful)

    plain = ~empty & ~auxiliary & ~terms
    flags = F.array_compact(F.array(
        _flag(F.col("size") < c.min_size, "too_short"), _flag(F.col("size") > c.max_size, "too_long"), _flag(F.col("size") > c.max_size, "oversized"),
        _flag(fences | F.col("extra")["code_split"], "code_split"), _flag(table, "fragmented_table"), _flag(cut_list, "fragmented_list"), _flag(open_end | low_start, "broken_sentence"), _flag(shift, "mixed_topics"),
        _flag(bare | (context < 0.35), "low_context"), _flag((n < 8) | (info < 0.35) | (plain & few), "low_information"),
        _flag(empty, "heading_only"), _flag(~empty & role.isin("document_meta", "navigation"), "metadata_only"), _flag(~empty & ((role == "retrieval_terms") | (terms & ~auxiliary)), "keyword_heavy"),
        _flag(~empty & ~auxiliary & terms & (m["alias"] >= 0.55), "alias_heavy"), _flag(plain & orphan, "orphaned_context"), F.col("duplicate_kind"),
    ))
    context = F.when(bare, context * 0.5).otherwise(context)
    total = retrieval * 0.3 + info * 0.25 + coherence * 0.2 + context * 0.15 + length * 0.1
    parts = {"quality_score": total, "length_score": length, "coherence_score": coherence, "context_score": context, "information_score": info, "retrieval_score": retrieval}
    scored = chunks if "duplicate_kind" in chunks.columns else chunks.withColumn("duplicate_kind", F.lit(None).cast("string"))
    return scored.withColumn("quality", F.struct(*[F.round(v, 4).alias(k) for k, v in parts.items()], flags.alias("flags")))


def finalize(chunks: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Duplicates, scores, the low-quality filter, then positions and neighbours of what is left."""
    cfg = cfg or Config()
    out = deduplicate(chunks, cfg)
    if cfg.quality.enabled:
        out = score(out, cfg)
        if cfg.quality.drop_below_minimum and cfg.quality.minimum_score > 0:
            out = out.where(F.col("quality.quality_score") >= cfg.quality.minimum_score)
    return corpus.reindex(out.drop("previous_chunk", "next_chunk"), "document_id", "chunk_index", "id")


def audit(processed: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Where every block of the documents went, see corpus.coverage."""
    blocks = blocks_of(processed).select(F.col("document_id").alias("doc"), "block", "text")
    kept = chunks.select(F.col("document_id").alias("doc"), F.when(F.col("semantic_role").isin(*AUXILIARY_ROLES), "metadata").otherwise("knowledge").alias("destination"), F.col("content").alias("text"))
    terms = chunks.select(F.col("document_id").alias("doc"), F.lit("retrieval_terms").alias("destination"), F.array_join(F.concat(*[f"retrieval.{f}" for f in FIELDS]), " ").alias("text"))
    return corpus.coverage(blocks, kept.unionByName(terms), strict=strict)


def reports(processed: DataFrame) -> DataFrame:
    """A row per document, failed ones too: characters before cleaning, blocks, chunks, strategy, error."""
    return processed.select("document_id", "title", "source", "characters", F.col("n_blocks").alias("blocks"), F.size("chunks").alias("chunks"), "strategy", "error")


def run(documents: DataFrame, cfg: Config | None = None, audited: bool | None = None, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """The finished chunk table and the per-document kernel output it was made of (written once).

    Blocks are kept for ``audit`` unless quality.validate_information_loss (or ``audited``) says otherwise.
    """
    cfg, progress = cfg or Config(), progress or Silent()
    progress.start(2, "chunking")
    processed = corpus.cut(process(documents, cfg, cfg.quality.validate_information_loss if audited is None else audited))
    progress.advance("context, duplicates and scores")
    chunks = finalize(enrich(chunks_of(processed, cfg), cfg), cfg)
    progress.advance("embeddings" if cfg.embeddings.enabled else "ready")
    if cfg.embeddings.enabled:
        from chunkloom.operators.embeddings import embed_chunks

        chunks = embed_chunks(chunks, cfg.embeddings)
    progress.finish()
    return chunks, processed
