"""Random choices as keyed hashes: the same in every partitioning, and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed(seed: int | str, salt: str, *keys: Column | str) -> Column:
    """The first 8 hex digits of md5("seed:salt:key...") as a number."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def keyed_sql(seed: int | str, salt: str, *keys: str) -> str:
    """The same in DuckDB."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', '{salt}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT"
