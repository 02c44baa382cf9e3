"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.llm.hnsw import op8_hnsw_neighbours
from lodestar.llm.mil import op6_mil_quality
from lodestar.llm.mixing import OP7_SQL, op7_source_mixing
from lodestar.llm.packing import op5_best_fit_packing
from lodestar.llm.prefix_counts import op10_prefix_token_counts
from lodestar.llm.rans import op1_rans_token_ids
from lodestar.llm.rules import op3_weak_supervision_rules
from lodestar.llm.secrets import op9_secret_scan
from lodestar.llm.simhash import op4_simhash_near_dedup
from lodestar.llm.substrings import op2_substring_dedup

_ALL = (op1_rans_token_ids, op2_substring_dedup, op3_weak_supervision_rules, op4_simhash_near_dedup, op5_best_fit_packing, op6_mil_quality, op7_source_mixing, op8_hnsw_neighbours, op9_secret_scan, op10_prefix_token_counts)

QUERIES = {f.__name__: f for f in _ALL}

OP2_SQL = """
WITH split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM split WHERE len(words) >= 35),
keyed AS (SELECT r, i, sha256(array_to_string(list_slice(words, i, i + 34), ' ')) AS k FROM starts),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM keyed),
placed AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM split),
marked AS (SELECT p.r, p.i, p.word, max(CASE WHEN c.n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM placed p LEFT JOIN counted c ON p.r = c.r AND p.i = c.i),
done AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM marked GROUP BY r)
SELECT s.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN done d ON s.r = d.r
"""

ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op7_source_mixing": OP7_SQL}
