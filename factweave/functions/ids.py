"""Deterministic identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of this engine; every id below is a name-based (version 5) UUID in one of them.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factweave:facts")
CONFLICT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factweave:conflict-pair")
SIGNAL_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factweave:signal")
MERGE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factweave:merge")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a UTF-8 name; equal to ``uuid.uuid5`` and evaluated in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def fact_uuid(name: Column) -> Column:
    return uuid5(NAMESPACE, name)


def reference_id(col: Column) -> Column:
    """Irreversible short id for audit rows."""
    return F.substring(F.sha2(col, 256), 1, 16)


def conflict_pair_id(left_claim: Column, right_claim: Column, property_name: Column, scope_text: Column) -> Column:
    """Symmetric pair id: the two claim ids in sorted order, the property and the shared scope text."""
    key = F.concat_ws("|", F.least(left_claim, right_claim), F.greatest(left_claim, right_claim), property_name, scope_text)
    return uuid5(CONFLICT_NAMESPACE, key)
