"""Options of the engine, from the environment, and the catalogs they switch on."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from . import lines
from .rest import TrackSearch, VideoSearch

PREFIX = "LINKENGINE_"
_YES, _NO = {"1", "true", "yes", "on", "t", "y"}, {"0", "false", "no", "off", "f", "n"}


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    store_path: str | None = None
    confidence_threshold: float = 0.8
    enable_demo_provider: bool = True
    spotify_access_token: str | None = None
    spotify_client_id: str | None = None
    spotify_client_secret: str | None = None
    spotify_market: str | None = None
    youtube_api_key: str | None = None
    youtube_region_code: str | None = None
    youtube_relevance_language: str | None = None

    def __post_init__(self):
        if not 0.0 <= self.confidence_threshold <= 1.0:
            raise ValueError("confidence_threshold must be between 0.0 and 1.0")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = PREFIX) -> Settings:
        """Settings whose variables are there; names are upper-cased behind the prefix."""
        env = os.environ if env is None else env
        given = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        if "confidence_threshold" in given:
            given["confidence_threshold"] = float(given["confidence_threshold"])
        if "enable_demo_provider" in given:
            given["enable_demo_provider"] = _switch("enable_demo_provider", given["enable_demo_provider"])
        return cls(**given)


def _switch(name: str, text: str) -> bool:
    word = text.strip().lower()
    if word not in _YES | _NO:
        raise ValueError(f"{name} must be a boolean, not {text!r}")
    return word in _YES


def catalogs(spark: SparkSession, settings: Settings) -> list[tuple[str, DataFrame]]:
    """The catalogs that are tables, by source."""
    return [("demo", lines.demo_catalog(spark))] if settings.enable_demo_provider else []


def searches(settings: Settings) -> list[tuple[str, TrackSearch | VideoSearch]]:
    """The search services with the credentials they need, by source."""
    out: list[tuple[str, TrackSearch | VideoSearch]] = []
    s = settings
    if s.spotify_access_token or (s.spotify_client_id and s.spotify_client_secret):
        out.append(("spotify", TrackSearch(s.spotify_access_token, s.spotify_client_id, s.spotify_client_secret, s.spotify_market)))
    if s.youtube_api_key:
        out.append(("youtube", VideoSearch(s.youtube_api_key, s.youtube_region_code, s.youtube_relevance_language)))
    return out
