"""Object-key columns (PRJ-2, PRJ-3, PRJ-4, PRJ-5, PRJ-17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.schemas import JOB_PREFIX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_base(key) -> Column:
    """A key without its extension: what stands before the last dot, or all of it."""
    return F.regexp_replace(_c(key), r"\.[^.]*$", "")


def media_format(key) -> Column:
    """The extension of a key: what stands behind the last dot, or all of it."""
    return F.regexp_extract(_c(key), r"([^.]*)$", 1)


def client_stem(name) -> Column:
    """The viewer's stem of a file name: all dot parts but the last; empty for a name without a dot."""
    parts = F.split(_c(name), r"\.", -1)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def job_name(key) -> Column:
    return F.concat(F.lit(JOB_PREFIX), key_base(key))


def output_key(job) -> Column:
    return F.concat(_c(job), F.lit(".json"))


def enhanced_key(out_key) -> Column:
    """Every ``.json`` in the key becomes ``_enhanced.json``."""
    return F.replace(_c(out_key), F.lit(".json"), F.lit("_enhanced.json"))


def first_bucket(bucket) -> Column:
    """PRJ-17: a bucket given as a JSON list means its first element."""
    b = _c(bucket)
    as_list = F.from_json(b, "array<string>")
    return F.when(F.startswith(F.ltrim(b), F.lit("[")), F.get(as_list, 0)).otherwise(b)


def uri_bucket_key(uri) -> tuple[Column, Column]:
    """PRJ-5: result URI -> (first path part, rest of the path)."""
    path = F.try_parse_url(_c(uri), F.lit("PATH"))
    parts = F.split(path, "/", -1)
    bucket = F.get(parts, 1)
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    return bucket, F.when(path.isNotNull() & bucket.isNotNull(), rest)
