"""Queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from . import exact_dedup, fill_middle, fingerprint, idfiles, packing, prefix_trie, quality, sentencepieces, simhash, substring, toxicity, trie_bpe, warc

QUERIES = {
    f.__name__: f
    for f in (
        substring.op1_substring_dedup, packing.op2_best_fit_packing, fingerprint.op3_fingerprint, quality.op4_quality, idfiles.op5_token_ids,
        warc.op6_warc, sentencepieces.op7_sentencepiece, simhash.op8_simhash_near_dedup, exact_dedup.op9_exact_dedup, toxicity.op10_toxicity,
        trie_bpe.op11_trie_bpe, prefix_trie.op12_prefix_trie, fill_middle.op13_fill_middle,
    )
}

_OP1 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS k FROM w)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.k FROM win JOIN least USING (s) WHERE least.m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM (SELECT doc_id, k, unnest(range(0, 13)) AS j FROM hit)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.p) AS t FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p WHERE gone.p IS NULL GROUP BY each.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS holder FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM d
"""

#: Operators that SQL cannot express (hashes, tokenizers and models DuckDB does not have) are left out; tests hold them against brute force.
SQL = {"op1_substring_dedup": _OP1, "op6_warc": _OP6, "op9_exact_dedup": exact_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL}
