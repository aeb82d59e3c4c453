"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from graphleaf.llm import centroids, chat, decontaminate, divergence
from graphleaf.llm.centroids import op11_centroid_clustering
from graphleaf.llm.chat import op3_chat_format
from graphleaf.llm.chunk_dedup import op1_chunk_dedup
from graphleaf.llm.decontaminate import op2_decontamination
from graphleaf.llm.divergence import op12_source_divergence
from graphleaf.llm.fingerprints import op8_fingerprints
from graphleaf.llm.near_dedup import op10_near_duplicates
from graphleaf.llm.neighbours import op13_nearest_neighbours
from graphleaf.llm.packing import op6_packing
from graphleaf.llm.quality import op7_quality
from graphleaf.llm.sharding import op9_kd_sharding
from graphleaf.llm.suffix_dedup import op5_suffix_dedup
from graphleaf.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_chunk_dedup": op1_chunk_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_source_divergence": op12_source_divergence,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op3_chat_format": chat.ORACLE_SQL,
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
