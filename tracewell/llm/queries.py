"""The queries of this subpackage by name, and their SQL."""

from .decontam import op1_benchmark_decontamination
from .filteraudit import OP11_SQL, op11_filter_interaction_audit
from .jaccard import OP2_SQL, op2_ngram_jaccard_join
from .langid import op9_language_id
from .packing import op6_best_fit_packing
from .preferences import OP8_SQL, op8_preference_formatting
from .quality import ABLATIONS_SQL, OP5_SQL, op5_quality_rules, quality_ablations
from .secrets import op4_secret_scans
from .sentences import op7_substring_dedup
from .sharding import op10_sharding
from .suffixes import op3_suffix_dedup
from .urlfilter import OP12_SQL, op12_url_filters
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_suffix_dedup, op4_secret_scans, op5_quality_rules, op6_best_fit_packing, op7_substring_dedup, op8_preference_formatting, op9_language_id, op10_sharding, op11_filter_interaction_audit, op12_url_filters, op13_embedding_whitening, quality_ablations)}
ORACLES = {"op2_ngram_jaccard_join": OP2_SQL, "op5_quality_rules": OP5_SQL, "quality_ablations": ABLATIONS_SQL, "op8_preference_formatting": OP8_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_url_filters": OP12_SQL}
