"""Content, chunk, semantic and cache hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_hash(path: Column, index: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("#"), index.cast("string"), F.lit("\n"), content), 256)


def semantic_hash(name: Column, kind: Column, description: Column, signature: Column, side_effects: Column, hooks: Column, behavior: Column | None = None) -> Column:
    """Hash of the parts that bear on meaning; an explicit null differs from an absent part."""
    fields = [name.alias("name"), kind.alias("type"), description.alias("description"), signature.alias("signature"), F.array_sort(side_effects).alias("sideEffects"), F.array_sort(hooks).alias("hooks")]
    if behavior is not None:
        fields.append(F.array_sort(behavior).alias("behavior"))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def cache_key(prefix: str, text: Column, length: int = 64) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))
