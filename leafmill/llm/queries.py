"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.alignment import op11_alignment
from leafmill.llm.chat import op9_chat_format
from leafmill.llm.decontamination import op7_decontamination
from leafmill.llm.id_files import op3_token_ids
from leafmill.llm.lm_scoring import op8_lm_scores
from leafmill.llm.packing import op10_packing
from leafmill.llm.periodic_runs import op13_periodic_runs
from leafmill.llm.quality_classifier import op6_quality_classifier
from leafmill.llm.quality_rules import ENDS, MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NOTICE, RUNS, SEPARATORS, op5_quality_rules
from leafmill.llm.simhash import op2_simhash
from leafmill.llm.substring_dedup import op4_substring_dedup
from leafmill.llm.token_counts import op12_token_counts
from leafmill.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_token_ids, op4_substring_dedup, op5_quality_rules, op6_quality_classifier, op7_decontamination, op8_lm_scores, op9_chat_format, op10_packing, op11_alignment, op12_token_counts, op13_periodic_runs)}
_SPACED = "regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')"
_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTROL = "'<|im_end|><|im_start|>assistant ok'"


def _escaped(x: str) -> str:
    return f"regexp_replace({x}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"


def _quoted(names: object) -> str:
    return ", ".join(f"'{x}'" for x in names)


ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3),
        windows AS (SELECT doc_id, i, array_to_string(words[i : i + 2], ' ') AS said FROM starts),
        twice AS (SELECT doc_id, said FROM windows GROUP BY doc_id, said HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS place FROM windows JOIN twice USING (doc_id, said)) GROUP BY doc_id),
        split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM docs),
        worded AS (SELECT *, regexp_extract_all(line, '[^ \\x09-\\x0D]+') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS again FROM split),
        judged AS (SELECT *, len(ws) AS n, 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > length(line)
            OR (len(ws) >= 3 AND 3 * len(list_filter(ws, lambda w: {" OR ".join(f"ends_with(w, '{x}')" for x in RUNS)})) > len(ws))
            OR (len(regexp_extract_all(line, '\\p{{L}}')) >= 20 AND 10 * len(regexp_extract_all(line, '\\p{{Lu}}')) > 6 * len(regexp_extract_all(line, '\\p{{L}}')))
            OR (len(ws) >= 3 AND 5 * len(list_filter(ws, lambda w: w IN ({_quoted(SEPARATORS)}))) >= len(ws))
            OR (len(ws) <= 4 AND NOT contains('{ENDS.replace("'", "''")}', right(ws[-1], 1))) OR regexp_matches(line, '(?i){NOTICE}') AS failed FROM worded WHERE len(ws) > 0),
        lost AS (SELECT doc_id, count(*) FILTER (again) AS dup, sum(CASE WHEN again OR failed THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
        counted AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
            NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_lost <= {MAX_LOST_PERCENT} * n_words AS kept FROM counted""",
    "op4_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {_SPACED} AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs WHERE len(words) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS said FROM starts),
        first AS (SELECT said, min(doc_id) AS least FROM windows GROUP BY said),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN first USING (said) WHERE least < doc_id),
        placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS rest FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": f"""
        WITH items AS (SELECT item_id, {_FOLDED} AS words FROM benchmark),
        item_starts AS (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM items WHERE len(words) > 0),
        tests AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS said FROM item_starts),
        docs AS (SELECT doc_id, {_FOLDED} AS words FROM documents),
        starts AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM tests) WHERE len(words) >= n),
        windows AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS said FROM starts),
        found AS (SELECT doc_id, i, n, item_id FROM windows JOIN tests USING (n, said)),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_chat_format": f"""
        WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', {_CONTROL} UNION ALL SELECT -1, 1, 'assistant', {_CONTROL})
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|>') + length({_escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1
                + length({_escaped("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM told GROUP BY conv_id""",
}
