"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_styletree import op1_styletree
from .op10_language import op10_language
from .op11_audit import SQL as OP11_SQL
from .op11_audit import op11_audit
from .op12_bpe import op12_bpe
from .op13_repair import SQL as OP13_SQL
from .op13_repair import op13_repair
from .op2_simhash import op2_simhash
from .op3_pii import op3_pii
from .op4_archive import op4_archive
from .op5_repetition import SQL as OP5_SQL
from .op5_repetition import op5_repetition
from .op6_kdtree import op6_kdtree
from .op7_pitmanyor import op7_pitmanyor
from .op8_latent import op8_latent
from .op9_raking import op9_raking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_styletree": op1_styletree,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_archive": op4_archive,
    "op5_repetition": op5_repetition,
    "op6_kdtree": op6_kdtree,
    "op7_pitmanyor": op7_pitmanyor,
    "op8_latent": op8_latent,
    "op9_raking": op9_raking,
    "op10_language": op10_language,
    "op11_audit": op11_audit,
    "op12_bpe": op12_bpe,
    "op13_repair": op13_repair,
}

SQL: dict[str, str] = {"op5_repetition": OP5_SQL, "op11_audit": OP11_SQL, "op13_repair": OP13_SQL}
