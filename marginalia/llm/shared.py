"""Places that every executor can reach, and columns handed to an operator under fixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, new_path, removed, written

__all__ = ["Scratch", "byte_letters", "keyed_text", "new_path", "removed", "text_bytes", "written"]


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as __id and __text: other columns can then have any name."""
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts; one number reaches the driver."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins for bytes in byte-level vocabularies: a byte that is a printable Latin-1
    character stands for itself, the others for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
