"""Text functions as Spark expressions (JVM side, inside code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters they stand for.
MARKED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīıłñńňòóôõöøōőřśšşťţùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeegiiiiiilnnnoooooooorsssttuuuuuuuyyzzz"


def folded(c: Column | str) -> Column:
    """Lower case without accents; ß is ss, æ is ae, œ is oe. Null stays null."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    c = F.replace(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.translate(c, MARKED, PLAIN)


def words(c: Column | str) -> Column:
    """``folded`` with every run of other characters than letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)
