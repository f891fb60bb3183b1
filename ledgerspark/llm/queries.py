"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from ledgerspark.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from ledgerspark.llm.license_scan import op8_license_scan
from ledgerspark.llm.mixing import op3_mixing
from ledgerspark.llm.ngram_join import op4_ngram_join
from ledgerspark.llm.packing import op7_best_fit_packing, packing_by_cost
from ledgerspark.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from ledgerspark.llm.quality_classifier import op5_quality_classifier
from ledgerspark.llm.quality_rules import LANGUAGE_HOSTS_SQL, OP2_SQL, language_hosts, op2_quality_rules
from ledgerspark.llm.secret_scan import OP12_SQL, op12_secret_scan
from ledgerspark.llm.sharding import op10_sharding
from ledgerspark.llm.topk_search import OP9_SQL, op9_topk_search
from ledgerspark.llm.toxicity import op6_toxicity
from ledgerspark.llm.url_filters import MIRRORS_SQL, OP1_SQL, op1_url_filters, url_mirrors

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_topk_search": op9_topk_search,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
    "language_hosts": language_hosts,
    "packing_by_cost": packing_by_cost,
    "url_mirrors": url_mirrors,
}

ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op9_topk_search": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
    "language_hosts": LANGUAGE_HOSTS_SQL,
    "url_mirrors": MIRRORS_SQL,
}
