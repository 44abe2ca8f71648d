"""Path and file-size column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.binding import let


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/"


def located(path: Column, base: str) -> Column:
    """The whole location of a path: its scheme, host and absolute path.

    ``base`` is a whole location (as Hadoop writes it) that relative paths start from; paths without a
    scheme, and paths with its scheme but no host, are on its file system. A leading ``./`` is dropped.
    """
    scheme, _, rest = base.partition(":")
    system = f"{scheme}:"
    if rest.startswith("//"):
        system += "//" + rest[2:].partition("/")[0]
    one_slash = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/")

    def whole(p: Column) -> Column:
        hostless = p.startswith(f"{scheme}:/") & ~p.startswith(f"{scheme}://")
        return (
            F.when(hostless, F.concat(F.lit(system), F.substring(p, len(scheme) + 2, 1 << 30)))
            .when(p.rlike(_SCHEME), p)
            .when(p.startswith("/"), F.concat(F.lit(system), p))
            .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(p, r"^(\./+)+", "")))
        )

    return F.when(path.isNotNull(), let(one_slash, whole))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' when the name has none or only a leading dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def size_mb(length: Column) -> Column:
    """Bytes to decimal megabytes with three decimals."""
    return F.round(length / F.lit(1e6), 3)
