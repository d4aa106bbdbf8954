"""What a library may be told; every field has a default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from larder.operators import heuristics as H
from larder.operators.embedding import Provider
from larder.operators.merge import Tier


@dataclass(frozen=True)
class Enricher:
    """A provider of enrichments: rows (url_hash, canonical_url, platform, document, media_url, duration_s, mode) to rows
    (url_hash, answer: JSON text, model, input_tokens, output_tokens); a row that it leaves out has failed.
    """

    name: str
    enrich: Callable[[DataFrame], DataFrame]
    modes: tuple[str, ...] = ("metadata",)
    available: bool = True
    reason: str | None = None


@dataclass(frozen=True)
class Options:
    #: The embedding model's name and dimension, its provider (None: hashed words) and whether it can be reached.
    model: str = "hashed-words"
    dim: int = 64
    embedder: Provider | None = None
    can_embed: bool = True
    #: Extraction tiers in order; None: client payload, video metadata, scraping service, web page.
    tiers: tuple[Tier, ...] | None = None
    #: Enrichment providers in order; the model-free one always comes last.
    enrichers: tuple[Enricher, ...] = ()
    allow_media: bool = True
    longest_media_s: float = 1800.0
    most_usd_an_item: float = 0.02
    priced_model: str = "gemini-2.5-flash"
    longest_document: int = 12_000
    stopwords: tuple[str, ...] = field(default_factory=lambda: tuple(H.stopwords()))
    #: Hash buckets of each stored table: a change rewrites those that it touches.
    buckets: int = 16
