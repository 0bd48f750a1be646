"""Content hashes and deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 id of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.conv(((F.conv(F.substring(h, 17, 1), 16, 10).cast("int")).bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(source_id: Column, document_id: Column, index: Column, digest: Column) -> Column:
    return uuid5(F.concat_ws(":", source_id.cast("string"), document_id.cast("string"), index.cast("string"), digest))
