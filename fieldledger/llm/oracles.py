"""DuckDB statements of the operators' queries."""

from __future__ import annotations

from fieldledger.llm import licences

SHARDS = 40
SLOT_RUNS = 1024


def _hash52(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _shards() -> str:
    scores = ", ".join(_hash52(f"doc_id::VARCHAR || '#{i}'") for i in range(SHARDS + 1))
    return f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
bytes AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda b: ('0x' || b)::BIGINT) AS b
  FROM documents
),
summed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
        4294967295) AS text_crc32
  FROM bytes, crc_table
),
scored AS (
  SELECT *, [{scores}] AS scores,
    {_hash52("doc_id::VARCHAR || '#run' || text_crc32::VARCHAR")} % {SLOT_RUNS} AS run
  FROM summed
),
placed AS (
  SELECT *, list_position(scores[1:{SHARDS}], list_max(scores[1:{SHARDS}])) - 1 AS shard,
    list_position(scores, list_max(scores)) - 1 AS grown
  FROM scored
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY run, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard
FROM placed
"""


def _licences() -> str:
    known = ", ".join(f"'{s}': '<{i}>'" for s, i in licences.known_sentences().items())
    rules = ", ".join(
        f"{{'seq': '', 'names': ['{name}'], 'hits': 0, 'run': '{licences.rule_text(ids)}'}}"
        for name, ids in licences.licence_rules()
    )

    def lines(body: str) -> str:
        cut = f"regexp_replace({body}, '{licences.SENTENCE_END}', chr(10), 'g')"
        plain = f"regexp_replace({cut}, '[^a-z0-9\\n]+', ' ', 'g')"
        edged = f"regexp_replace({plain}, ' *\\n *|^ | $', chr(10), 'g')"
        bare = f"regexp_replace({edged}, '{licences.BULLET}', '', 'g')"
        return f"regexp_replace({bare}, '{licences.LEAD}', 'under ', 'g')"

    def sequence(text: str) -> str:
        ids = f"""list_transform(list_filter(string_split({text}, chr(10)), lambda s: s <> ''),
          lambda s: coalesce(known[s], '~'))"""
        return f"regexp_replace(array_to_string({ids}, ''), '~+', '~', 'g')"

    def matched(seq: str) -> str:
        return f"""list_reduce(list_prepend({{'seq': {seq}, 'names': []::VARCHAR[], 'hits': 0, 'run': ''}}, rules),
          lambda a, r: {{'seq': replace(a.seq, r.run, '|'),
            'names': CASE WHEN contains(a.seq, r.run) THEN list_concat(a.names, r.names) ELSE a.names END,
            'hits': a.hits + ((length(a.seq) - length(replace(a.seq, r.run, '|'))) // (length(r.run) - 1))::INTEGER,
            'run': ''}})"""

    wrapped = f"translate(regexp_replace(body, '{licences.PARAGRAPH_END}', '. ', 'g'), chr(13) || chr(10), '  ')"
    return f"""
WITH tables AS (SELECT MAP {{{known}}} AS known, [{rules}] AS rules),
docs AS (SELECT doc_id, lower(coalesce(text, '')) AS body FROM documents),
once AS (SELECT doc_id, body, rules, known, {sequence(lines('body'))} AS seq FROM docs, tables),
first AS (SELECT *, {matched('seq')} AS m FROM once),
again AS (
  SELECT *, CASE WHEN len(m.names) = 0 AND regexp_matches(body, '{licences.LICENCE_WORDS}')
    THEN {sequence(lines(wrapped))} END AS seq2 FROM first),
two AS (SELECT *, CASE WHEN contains(seq2, '<') THEN {matched('seq2')} END AS m2 FROM again),
best AS (
  SELECT doc_id, CASE WHEN len(m2.names) > 0 THEN m2 ELSE m END AS b,
    CASE WHEN len(m2.names) > 0 THEN seq2 ELSE seq END AS s
  FROM two)
SELECT doc_id,
  array_to_string(list_filter(b.names, lambda x, i: list_position(b.names, x) = i), ',') AS licences,
  b.hits::BIGINT AS statements, (length(s) - length(replace(s, '<', '')))::BIGINT AS known_sentences,
  (length(b.seq) - length(replace(b.seq, '<', '')))::BIGINT AS unmatched,
  CASE WHEN contains(s, '<') THEN s ELSE '' END AS sequence
FROM best
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Whole numbers below 2**53 are exact in the inner products."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pieces AS MATERIALIZED (
  SELECT rid, part, v[len(v) * part // {parts} + 1 : len(v) * (part + 1) // {parts}] AS x
  FROM kept, (SELECT unnest(range({parts})) AS part)
),
sized AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM pieces),
book0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, x AS y, list_inner_product(x, x) AS yy FROM pieces WHERE rid <= {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, p.part, min({{'d': (xx - 2 * list_inner_product(x, y) + yy)::BIGINT, 'e': entry}}) AS best
  FROM sized AS p JOIN book{k} AS b ON p.part = b.part
  GROUP BY rid, p.part
)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, list(((s - (((s % n) + n) % n)) // n)::DOUBLE ORDER BY pos) AS y
  FROM (
    SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n
    FROM (
      SELECT p.part, best.e AS entry, unnest(x) AS x, generate_subscripts(x, 1) AS pos
      FROM pieces AS p JOIN near{k} AS n ON p.rid = n.rid AND p.part = n.part
    )
    GROUP BY ALL
  )
  GROUP BY part, entry
),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, y, list_inner_product(y, y) AS yy
  FROM (
    SELECT b.part, b.entry, coalesce(m.y, b.y) AS y
    FROM book{k} AS b LEFT JOIN mean{k} AS m ON b.part = m.part AND b.entry = m.entry
  )
)""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near{rounds} GROUP BY rid
),
flat AS (
  SELECT part, entry, unnest(y)::BIGINT AS y, generate_subscripts(y, 1) AS pos FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM flat) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


STATEMENTS: dict[str, str] = {
    "op1_licence_scan": _licences(),
    "op2_rendezvous_shards": _shards(),
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
""",
    "op12_vector_codes": _vector_codes(),
}
