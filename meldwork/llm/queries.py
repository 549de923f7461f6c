"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from meldwork.llm.common import purge
from meldwork.llm.decontaminate import op4_decontamination
from meldwork.llm.fingerprints import op10_fingerprints
from meldwork.llm.html_main import op7_html_extraction
from meldwork.llm.line_dedup import OP1_SQL, op1_line_dedup
from meldwork.llm.near_dedup import op9_near_dedup
from meldwork.llm.packing import op6_packing
from meldwork.llm.periods import op11_periodic_runs
from meldwork.llm.pii import op5_pii
from meldwork.llm.quality import op8_quality
from meldwork.llm.repeats import op3_repeats
from meldwork.llm.secret_scan import op13_secret_scan
from meldwork.llm.sharding import op2_sharding
from meldwork.llm.whitening import op12_embedding_whitening

__all__ = ["ORACLES", "QUERIES", "purge"]

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_repeats": op3_repeats,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
}
