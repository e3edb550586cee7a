"""Queries of the corpus operators over the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from packspan.llm import decontam, oracles, warc
from packspan.llm.language import op3_language
from packspan.llm.neardup import op8_neardup
from packspan.llm.quality import op2_quality
from packspan.llm.sentencepiece_fst import op1_sentencepiece
from packspan.llm.sstable import op7_sstable
from packspan.llm.sharding import op4_sharding
from packspan.llm.vectors import op6_vectors
from packspan.llm.toxicity import op9_toxicity


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_quality": op2_quality,
        "op3_language": op3_language,
        "op4_sharding": op4_sharding,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_vectors": op6_vectors,
        "op7_sstable": op7_sstable,
        "op8_neardup": op8_neardup,
        "op9_toxicity": op9_toxicity,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": oracles.OP4,
        "op5_decontamination": decontam.ORACLE,
        "op6_vectors": oracles.OP6,
        "op8_neardup": oracles.OP8,
        "op10_warc": oracles.OP10,
    }
