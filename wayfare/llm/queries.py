"""The text operators' queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .fingerprints import op3_fingerprints
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .packing import op1_packing
from .quality import OP8_SQL, op8_quality
from .quotation import OP10_SQL, QUOTED_SQL, op10_quotation, quoted_replies
from .sharding import op2_sharding
from .sstable import op7_sstable
from .token_counts import op9_token_counts
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_sharding, op3_fingerprints, op4_toxicity, op5_jaccard_join, op6_bpe, op7_sstable, op8_quality, op9_token_counts, op10_quotation, quoted_replies)}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5_SQL, "op8_quality": OP8_SQL, "op10_quotation": OP10_SQL, "quoted_replies": QUOTED_SQL}
