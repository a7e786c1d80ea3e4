"""The operators' queries over the driver's tables, and SQL where SQL can state the result."""

from . import licences, mixing
from .forest import op8_forest
from .hmm import op4_hmm
from .language import op2_language
from .packing import op6_packing
from .repetition import op10_repetition
from .simhash import op1_simhash
from .sitetree import op3_sitetree
from .substring import op5_substring

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_sitetree": op3_sitetree,
    "op4_hmm": op4_hmm,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_licences": licences.op7_licences,
    "op8_forest": op8_forest,
    "op9_mixing": mixing.op9_mixing,
    "op10_repetition": op10_repetition,
}

ORACLE_SQL: dict[str, str] = {
    "op7_licences": licences.SQL,
    "op9_mixing": mixing.SQL,
    "op5_substring": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20),
        windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS key FROM starts),
        firsts AS (SELECT key, min(struct_pack(d := doc_id, s := i)) AS f FROM windows GROUP BY key),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
            FROM windows JOIN firsts USING (key) WHERE struct_pack(d := doc_id, s := i) > f),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
        kept AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS k, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
}
