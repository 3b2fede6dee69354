"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .jaccard_join import OP12_SQL, op12_jaccard_join
from .language_id import op10_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .mixing import OP5_SQL, op5_mix_sources, op5_mix_weights
from .packing import op1_pack_tokens
from .quality import op7_quality
from .revisits import OP9_SQL, op9_revisits
from .secret_scan import op8_secret_scan
from .simhash import op6_simhash
from .source_audit import OP11_SQL, op11_source_audit
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_tokens,
        op2_decontaminate,
        op3_exact_dedup,
        op4_license_scan,
        op5_mix_sources,
        op6_simhash,
        op7_quality,
        op8_secret_scan,
        op9_revisits,
        op10_language_id,
        op5_mix_weights,
        op11_source_audit,
        op12_jaccard_join,
        op13_vector_codes,
    )
}
ORACLES = {
    "op2_decontaminate": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_mix_sources": OP5_SQL,
    "op9_revisits": OP9_SQL,
    "op11_source_audit": OP11_SQL,
    "op12_jaccard_join": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
