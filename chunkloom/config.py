"""Configuration: frozen dataclasses with validation, read from mappings, YAML or JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

from chunkloom.errors import ConfigError

STRATEGIES = ("auto", "code", "recursive", "semantic", "sentence", "structural")
UNITS = ("characters", "tokens", "words")
OVERLAPS = ("same", "percentage", *UNITS)


@dataclass(frozen=True)
class Project:
    name: str = "rag-dataset"
    description: str = ""
    version: str = "1.0.0"


@dataclass(frozen=True)
class Chunking:
    strategy: str = "semantic"
    target_size: int = 500
    min_size: int = 100
    max_size: int = 800
    overlap: float = 75
    unit: str = "tokens"
    overlap_unit: str = "same"
    tokenizer: str = "heuristic"
    respect_sentence_boundaries: bool = True
    keep_code_blocks_intact: bool = True
    keep_tables_intact: bool = True
    merge_small_chunks: bool = True
    split_on_headings: bool = True
    max_heading_depth_split: int = 6

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES or self.unit not in UNITS or self.overlap_unit not in OVERLAPS:
            raise ConfigError(f"unknown strategy or unit: {self.strategy}, {self.unit}, {self.overlap_unit}")
        if not 0 < self.min_size <= self.target_size <= self.max_size:
            raise ConfigError("sizes must satisfy 0 < min_size <= target_size <= max_size")
        if self.overlap < 0 or self.overlap >= (100 if self.overlap_unit == "percentage" else self.target_size):
            raise ConfigError("overlap must be at least 0 and below 100 % or target_size")

    @property
    def overlap_size(self) -> int:
        return int(self.target_size * self.overlap / 100) if self.overlap_unit == "percentage" else int(self.overlap)


@dataclass(frozen=True)
class Cleaning:
    enabled: bool = True
    normalize_whitespace: bool = True
    collapse_blank_lines: bool = True
    normalize_unicode: bool = True
    unicode_form: str = "NFKC"
    normalize_quotes: bool = False
    remove_headers: bool = False
    remove_footers: bool = False
    remove_navigation: bool = False
    remove_urls: bool = False
    repeated_line_threshold: float = 0.6
    min_repeats_for_boilerplate: int = 3
    preserve_code_blocks: bool = True


@dataclass(frozen=True)
class Deduplication:
    enabled: bool = True
    similarity_threshold: float = 0.92
    method: str = "minhash"
    shingle_size: int = 5
    num_perm: int = 64
    action: str = "flag"
    scope: str = "global"
    min_length: int = 40

    def __post_init__(self) -> None:
        if self.method not in ("minhash", "exact") or self.action not in ("flag", "drop") or self.scope not in ("global", "document"):
            raise ConfigError("deduplication: method minhash|exact, action flag|drop, scope global|document")


@dataclass(frozen=True)
class Semantics:
    enabled: bool = True
    min_terms: int = 5
    max_terms_per_field: int = 256
    attach_terms_to_chunks: bool = True


@dataclass(frozen=True)
class Context:
    include_heading_path: bool = True
    include_source: bool = True
    include_document_title: bool = True
    add_prefix: bool = True
    prepend_context_to_content: bool = False
    heading_separator: str = " > "
    parent_level: str = "section"


@dataclass(frozen=True)
class Quality:
    enabled: bool = True
    minimum_score: float = 0.0
    drop_below_minimum: bool = False
    low_context_word_threshold: int = 12
    min_knowledge_words: int = 8
    validate_information_loss: bool = True


@dataclass(frozen=True)
class Embeddings:
    enabled: bool = False
    provider: str = "hash"
    model: str = ""
    dimensions: int = 256
    batch_size: int = 32
    embed_context_prefix: bool = True
    base_url: str = ""
    api_key_env: str = ""


@dataclass(frozen=True)
class Output:
    formats: tuple[str, ...] = ("jsonl",)
    directory: str = "output/chunks"
    statistics: bool = True
    pretty: bool = False
    overwrite: bool = True
    include_quality: bool = True


_ALIASES = {"threshold": "similarity_threshold", "size": "target_size", "chunk_size": "target_size", "format": "formats"}


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    chunking: Chunking = field(default_factory=Chunking)
    cleaning: Cleaning = field(default_factory=Cleaning)
    deduplication: Deduplication = field(default_factory=Deduplication)
    semantics: Semantics = field(default_factory=Semantics)
    context: Context = field(default_factory=Context)
    quality: Quality = field(default_factory=Quality)
    embeddings: Embeddings = field(default_factory=Embeddings)
    output: Output = field(default_factory=Output)

    @classmethod
    def of(cls, data: dict | None) -> Config:
        """From nested mappings; names that aren't known are errors."""
        parts = {f.name: f.default_factory for f in dataclasses.fields(cls)}
        out = {}
        for name, values in (data or {}).items():
            if name not in parts or not isinstance(values, dict):
                raise ConfigError(f"unknown section {name!r}", hint=f"sections: {', '.join(parts)}")
            known = {f.name for f in dataclasses.fields(parts[name])}
            named = {}
            for k, v in values.items():
                k = k if k in known else _ALIASES.get(k, k)
                if k not in known:
                    raise ConfigError(f"unknown option {name}.{k}")
                named[k] = tuple([v] if isinstance(v, str) else v) if k == "formats" else v
            out[name] = parts[name](**named)
        return cls(**out)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        p = Path(path)
        if not p.is_file():
            raise ConfigError(f"no configuration at {p}")
        text = p.read_text(encoding="utf-8")
        try:
            if p.suffix == ".json":
                return cls.of(json.loads(text))
            import yaml

            return cls.of(yaml.safe_load(text))
        except (ValueError, TypeError) as e:
            raise ConfigError(f"{p}: {e}") from e

    @classmethod
    def discover(cls, start: str | Path = ".", names: tuple[str, ...] = ("chunkloom.yaml", "chunkloom.yml", "chunkloom.json")) -> Config | None:
        """The first configuration found in ``start`` or a folder above it."""
        here = Path(start).resolve()
        for folder in (here, *here.parents):
            for name in names:
                if (folder / name).is_file():
                    return cls.load(folder / name)
        return None

    def to_dict(self) -> dict:
        return json.loads(json.dumps(dataclasses.asdict(self)))
