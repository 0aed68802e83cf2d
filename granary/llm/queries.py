"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embed import op2_embedding
from .langid import op10_language
from .media import op6_media
from .merkle import OP11_SQL, op11_merkle
from .minhash import op3_minhash
from .packing import op7_packing
from .pieces import op9_sentencepiece
from .pii import op1_pii
from .secrets import op12_secrets
from .substring import op5_substring
from .toxicity import op8_toxicity
from .warc import OP4_SQL, op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_embedding": op2_embedding,
        "op3_minhash": op3_minhash,
        "op4_warc": op4_warc,
        "op5_substring": op5_substring,
        "op6_media": op6_media,
        "op7_packing": op7_packing,
        "op8_toxicity": op8_toxicity,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_language": op10_language,
        "op11_merkle": op11_merkle,
        "op12_secrets": op12_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op11_merkle": OP11_SQL}
