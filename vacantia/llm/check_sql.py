"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from math import ceil

from vacantia.llm import license_scan as L
from vacantia.llm import secret_scan as S


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secrets() -> str:
    """Spans by splitting at each kind's pattern, owners by distinct counting, then all joined by row."""
    kinds = (*S.BASE, S.OPAQUE)

    def hits(rank: int) -> str:
        kind = kinds[rank]
        pattern = _text(kind.pattern)
        value = f"regexp_extract(hit, {pattern}, {kind.group})" if kind.group else "hit"
        return f"""SELECT row, source, {rank} AS rank, '{kind.name}' AS kind, start, start + length(hit) AS stop, {value} AS value FROM (
          SELECT row, source, found[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g)))
            + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS start FROM (
            SELECT row, source, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (
              SELECT row, source, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS found
              FROM docs WHERE regexp_matches(text, {_text(kind.hint)})) a) b) c WHERE length({value}) >= {kind.least}"""

    base = " UNION ALL ".join(hits(i) for i in range(len(S.BASE)))
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in kinds)
    listed = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    filled = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds)
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
      base AS MATERIALIZED ({base}),
      opaque AS MATERIALIZED (SELECT o.* FROM ({hits(len(S.BASE))}) o WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
        AND len(list_distinct(string_split(value, ''))) >= {S.OPAQUE_CHARACTERS}
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = o.row AND b.start < o.stop AND o.start < b.stop)),
      candidates AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
      owners AS (SELECT value, count(DISTINCT d.source) + count(DISTINCT doc_id) FILTER (d.source IS NULL) AS n,
        count(DISTINCT (coalesce('s' || d.source, ''), doc_id)) FILTER (doc_id IS NOT NULL) AS m
        FROM candidates c JOIN docs d USING (row) GROUP BY value),
      judged AS (SELECT c.*, n, m, n <= {S.LIVE_OWNERS} AND m <= {S.LIVE_REPOSITORIES} AS live FROM candidates c JOIN owners USING (value)),
      spans AS (SELECT * FROM judged WHERE rank < {len(S.BASE)} OR live),
      told AS (SELECT row, {counts}, count(*) FILTER (live) AS n_live, string_agg({listed}, ',' ORDER BY start, rank) AS spans,
        string_agg(n || ':' || m, ',' ORDER BY start, rank) AS copies,
        string_agg({listed}, ',' ORDER BY start, rank) FILTER (rank < {len(S.BASE)}) AS base FROM spans GROUP BY row)
      SELECT doc_id, {filled}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(copies, '') AS copies, coalesce(n_live, 0) AS n_live FROM docs LEFT JOIN told USING (row)"""


def licenses() -> str:
    """Places of phrases by list comparison, and the words of overlapping stretches against every template."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"({p.split()!r}, {_text(label)})" for p, label in L.PHRASES.items())

    def template(label: str, text: str) -> str:
        words = sorted({w.decode() for w in L.words_of(text.encode())})
        return f"({_text(label)}, {words!r}, {max(1, ceil(L.THRESHOLD * len(words) - 1e-9))})"

    templates = ", ".join(template(*t) for t in L.TEMPLATES)
    step = max(len(L.words_of(t.encode())) for _, t in L.TEMPLATES) - 1
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {lower} AS text FROM (
        SELECT doc_id, coalesce(text, '') AS text FROM documents) d),
      words AS MATERIALIZED (SELECT row, doc_id, regexp_extract_all(text, {word}) AS words FROM docs),
      phrases(phrase, label) AS (VALUES {phrases}),
      places AS (SELECT row, label, i - 1 AS place FROM (SELECT row, words, phrase, label,
          unnest(range(1, len(words) - len(phrase) + 2)) AS i FROM words, phrases
          WHERE list_has_all(words, phrase)) x WHERE words[i:i + len(phrase) - 1] = phrase),
      templates(label, wanted, need) AS (VALUES {templates}),
      blocks AS (SELECT row, spot, list_distinct(words[spot + 1:spot + {2 * step}]) AS held FROM (
          SELECT row, words, unnest(range(0, greatest(1, len(words) - {step}), {step})) AS spot FROM words) b),
      met AS MATERIALIZED (SELECT row, spot, label, hit, len(hit) AS n, len(hit) / len(wanted) AS share FROM (
          SELECT row, spot, label, wanted, need, list_intersect(held, wanted) AS hit FROM blocks, templates) h WHERE len(hit) >= need),
      best AS (SELECT row, label, share FROM met t WHERE NOT EXISTS (SELECT 1 FROM met u WHERE u.row = t.row
          AND abs(u.spot - t.spot) <= {step} AND (u.share > t.share OR u.share = t.share AND u.n > t.n) AND list_has_all(u.hit, t.hit))),
      base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY row),
      labels AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
        SELECT row, label FROM places UNION SELECT row, label FROM best) u GROUP BY row),
      scores AS (SELECT row, max(share) AS share FROM best GROUP BY row)
      SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
      FROM words LEFT JOIN base USING (row) LEFT JOIN labels USING (row) LEFT JOIN scores USING (row)"""
