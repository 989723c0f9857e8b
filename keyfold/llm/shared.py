"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfold.common import dropped, numbered, saved, scratch, shared_dir, shuffle_partitions, table

__all__ = ["crc_mod", "dropped", "numbered", "saved", "scratch", "shared_dir", "shuffle_partitions", "table", "whole_text"]


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m
