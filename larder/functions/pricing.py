"""Cost arithmetic: token prices, video tokens, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars for a million input and output tokens ------------------------
PRICES = {
    "gemini-3.7-flash": (0.75, 3.75), "gemini-3.6-flash": (0.75, 3.75), "gemini-3.5-flash": (1.50, 9.00),
    "gemini-3.1-flash": (0.50, 3.00), "gemini-3.1-flash-lite": (0.25, 1.50), "gemini-3.1-pro": (2.00, 12.00),
    "gemini-3.5-flash-lite": (0.30, 2.50), "gemini-2.5-flash": (0.30, 2.50), "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-2.5-pro": (1.25, 10.00), "gemini-embedding": (0.15, 0.0), "gemini-multimodal-embedding": (0.20, 0.0),
}
BATCH_DISCOUNT = 0.5
FRAME_TOKENS = {False: 70, True: 280}
AUDIO_TOKENS = 32
# ------------------------------------------------------------------------------------


def family(model: Column) -> Column:
    """A model's base name: without preview, latest and experiment marks and numbers at the end."""
    base = F.lower(F.trim(model))
    for mark in ("-preview", "-latest", "-exp"):
        base = F.regexp_replace(base, f"{mark}$", "")
    return F.regexp_replace(base, r"(-\d+)+$", "")


def _price(model: Column, side: int) -> Column:
    table = F.create_map(*[F.lit(x) for name, p in PRICES.items() for x in (name, p[side])])
    return F.coalesce(F.try_element_at(table, model), F.try_element_at(table, family(model)))


def is_priced(model: Column) -> Column:
    return model.isin(list(PRICES)) | family(model).isin(list(PRICES))


def cost(model: Column, input_tokens: Column, output_tokens: Column, batch: bool = False) -> Column:
    """Dollars of a call; an unknown model costs nothing rather than failing."""
    dollars = (input_tokens * _price(model, 0) + output_tokens * _price(model, 1)) / 1_000_000
    return F.coalesce(F.round(dollars * (BATCH_DISCOUNT if batch else 1.0), 8), F.lit(0.0))


def video_tokens(seconds: Column, high: bool = False, fps: float = 1.0, audio: bool = True) -> Column:
    """Predicted input tokens of a video."""
    frames = F.greatest(F.lit(1), F.floor(seconds * fps)) * FRAME_TOKENS[high]
    sound = F.floor(seconds * AUDIO_TOKENS) if audio else F.lit(0)
    return F.when(seconds > 0, frames + sound).otherwise(F.lit(0)).cast("bigint")


def video_cost(seconds: Column, model: Column, high: bool = False, output_tokens: int = 500) -> Column:
    return cost(model, video_tokens(seconds, high), F.lit(output_tokens))


def enrichment_mode(signal: Column, media_url: Column, media_kind: Column, duration_s: Column, longest_s: float = 1800) -> Column:
    """media where text says too little and there is media of a bearable length, else metadata."""
    media = F.coalesce((media_url != "") | (media_kind == "video"), media_kind == "video")
    wants = (signal != "strong") & media
    return F.when(wants & (F.coalesce(duration_s, F.lit(0.0)) <= longest_s), F.lit("media")).otherwise(F.lit("metadata"))


def within_budget(mode: Column, predicted: Column, ceiling: float) -> Column:
    """The mode, reduced to metadata where its predicted cost is over the ceiling."""
    return F.when((mode == "media") & (predicted > ceiling), F.lit("metadata")).otherwise(mode)
