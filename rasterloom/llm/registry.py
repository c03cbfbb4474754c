"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from rasterloom.llm import queries as q

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op")}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are four base32 letters.
_DIGEST = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {5 * (3 - k)}) & 31)::INT + 1, 1)" for i in range(8) for k in range(4))

ORACLE_SQL: dict[str, str] = {
    "op5_warc_zstd": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS largest FROM p)
        SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest,
            CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM d""",
}
