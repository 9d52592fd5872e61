"""Identifiers, Column to Column."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """First 20 hexadecimal digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 20)


def vector_key(c: Column) -> Column:
    """First 8 bytes of the SHA-256 without the sign bit, as a long."""
    wide = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(wide).cast("long")


def keyframe_id(video: Column, frame: Column) -> Column:
    return F.format_string("%s:%08d", video, frame)


def document_id(level: Column, key: Column) -> Column:
    return F.concat(level, F.lit(":"), key)


def dataset_group(video: Column) -> Column:
    """L-number of an id such as L21_V001, else what stands before the first underscore."""
    number = F.regexp_extract(video, r"^(L\d+)_V\d+$", 1)
    return F.when(number != "", number).otherwise(F.element_at(F.split(video, "_"), 1))


def config_hash(config: dict) -> str:
    """Hash of a configuration in canonical JSON; a driver-side literal."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def url_host(url: Column, hosts: list[str]) -> Column:
    """Host of a valid http(s) url on one of ``hosts`` or a subdomain of one, else null."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | host.endswith(f".{h}")
    return F.when(fits, host)


# Hosts of watch urls, of which the last one has the id as its path, and the form of an id.
WATCH_HOSTS, SHORT_HOST = ["youtube.com", "www.youtube.com", "m.youtube.com"], "youtu.be"
WATCH_ID = "^[A-Za-z0-9_-]{11}$"


def watch_id(url: Column) -> Column:
    """The 11 characters that name a video in a watch url: the first ``v`` parameter that is not empty, or the path of a
    short url. Null for any other host (compared whole, without case, port included), any other form and a null url."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.lower(F.regexp_extract(url, parts, 1))
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), "^/+|/+$", "")
    value = F.try_url_decode(F.regexp_extract(F.regexp_extract(url, parts, 3), r"(?:^|&)v=([^&]+)", 1))
    found = F.when(host == SHORT_HOST, path).when(host.isin(WATCH_HOSTS), value)
    return F.when(found.rlike(WATCH_ID), found)
