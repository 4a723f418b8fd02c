"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from tablescope.llm.byte_bpe import op5_byte_bpe
from tablescope.llm.decontaminate import OP8_SQL, op8_decontaminate
from tablescope.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tablescope.llm.filter_audit import OP12_SQL, op12_filter_audit
from tablescope.llm.html_extract import op1_html_extract
from tablescope.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from tablescope.llm.language_id import op2_language_id
from tablescope.llm.line_dedup import OP4_SQL, op4_line_dedup
from tablescope.llm.quality import op9_quality
from tablescope.llm.secret_scan import op7_secret_scan
from tablescope.llm.sharding import op10_sharding
from tablescope.llm.spelling import OP11_SQL, op11_spelling_variants
from tablescope.llm.warc_index import OP13_SQL, op13_warc_index

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc_index": op13_warc_index,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op8_decontaminate": OP8_SQL,
           "op11_spelling_variants": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_warc_index": OP13_SQL}
