"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespan.functions.text import norm_group


def group_key(source: Column, episode: Column) -> Column:
    """Canonical JSON of the normalised source and episode."""
    return F.to_json(F.array(norm_group(source), norm_group(episode)))


def sha_id(prefix: str, *parts: Column, length: int = 64) -> Column:
    """Domain-prefixed SHA-256, cut to ``length`` hex digits."""
    text = F.concat(F.lit(prefix + ":"), F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_language(tag: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.trim(tag), "_", "-"))
    return F.when(clean.rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8}){0,3}$"), clean)


def scope_id(project: Column, source_language: Column, target_language: Column) -> Column:
    """SHA-256 of the scope as JSON with sorted keys."""
    body = F.to_json(F.struct(
        project.alias("project_key"),
        canonical_language(source_language).alias("source_language"),
        canonical_language(target_language).alias("target_language")))
    return F.when(
        canonical_language(source_language) != canonical_language(target_language), F.sha2(body, 256))
