"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from sheaf.llm.embedding_dedup import op2_embedding_dedup
from sheaf.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from sheaf.llm.language_id import op3_language_id
from sheaf.llm.line_dedup import OP6_SQL, op6_line_dedup
from sheaf.llm.mixing import op4_mixing
from sheaf.llm.ngram_join import op8_ngram_join
from sheaf.llm.packing import op1_packing
from sheaf.llm.periodic_runs import op12_periodic_runs
from sheaf.llm.spelling import op11_spelling_variants
from sheaf.llm.toxicity import op9_toxicity
from sheaf.llm.training_order import op7_training_order
from sheaf.llm.url_filter import OP10_SQL, op10_url_filter
from sheaf.llm.word_bpe import op13_byte_bpe

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_embedding_dedup,
        op3_language_id,
        op4_mixing,
        op5_exact_dedup,
        op6_line_dedup,
        op7_training_order,
        op8_ngram_join,
        op9_toxicity,
        op10_url_filter,
        op11_spelling_variants,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

ORACLES = {
    "op5_exact_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_url_filter": OP10_SQL,
}
