"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from . import oracle
from .bpe import op7_byte_bpe
from .embed_dedup import op3_embedding_dedup
from .langid import op2_language_id
from .ngram_join import op10_ngram_jaccard
from .packing import op5_best_fit_packing
from .pii import op1_pii_surrogates
from .quality import op8_quality_divergence
from .sharding import op6_lpt_sharding
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates,
        op2_language_id,
        op3_embedding_dedup,
        op4_suffix_dedup,
        op5_best_fit_packing,
        op6_lpt_sharding,
        op7_byte_bpe,
        op8_quality_divergence,
        op9_toxicity,
        op10_ngram_jaccard,
    )
}
#: The others can't be told in SQL, or only at a cost that whole tables forbid; tests hold them against brute force.
ORACLE_SQL = {"op3_embedding_dedup": oracle.OP3, "op8_quality_divergence": oracle.op8(), "op10_ngram_jaccard": oracle.OP10}
