"""SQL equivalents that are put together from an operator's settings."""

from __future__ import annotations

from topicloom.llm import codes, mixing
from topicloom.llm.common import MAX_HEAVY_KEYS


def _unit(digest: str) -> str:
    return f"(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def mixing_sql(settings: mixing.Settings = mixing.Settings()) -> str:
    """Targets by sorted caps instead of rounds, positions by one window instead of cells."""
    weights = ", ".join(map(str, settings.weights))
    phase = " + ".join(
        f"CASE WHEN above * 16 >= source_size * {k} THEN 1 ELSE 0 END" for k in settings.phases
    )
    share, most = min(settings.share, float(settings.most)), f"{float(settings.most)}::DOUBLE"
    behind, spare = "(rest - words)", f"(rest * {most} - due)"
    part = "(rate - floor(rate))"
    copies = f"CAST(floor(rate) + floor(position * {part} + start) - floor((position - 1.0::DOUBLE) * {part} + start) AS BIGINT)"
    steps = ""
    for k in range(len(settings.phases) + 1):
        steps += f""",
    rates{k} AS (SELECT s.*, n_phase, words,
                        CASE WHEN rest <= 0 OR due * {behind} < longest * rest AND due * 2 <= {behind} * {most} THEN 0.0::DOUBLE
                             WHEN {spare} * {behind} < longest * rest AND {spare} * 2 <= {behind} * {most} THEN {most}
                             ELSE least(greatest(due / rest, 0.0::DOUBLE), {most}) END AS rate
                 FROM state{k} s JOIN totals USING (source_key) WHERE phase = {k}),
    got{k} AS (SELECT source_key, sum(size * {copies}) AS got FROM placed JOIN rates{k} USING (source_key)
               WHERE phase = {k} GROUP BY source_key),
    state{k + 1} AS (SELECT s.source_key, s.target, s.source_size, coalesce(s.due - got, s.due) AS due,
                            coalesce(s.rest - r.words, s.rest) AS rest,
                            coalesce(s.start + n_phase * {part} - floor(s.start + n_phase * {part}), s.start) AS start
                     FROM state{k} s LEFT JOIN rates{k} r USING (source_key) LEFT JOIN got{k} USING (source_key))"""
    rates = " UNION ALL ".join(
        f"SELECT source_key, {k} AS phase, rate, start, target, source_size FROM rates{k}" for k in range(len(settings.phases) + 1)
    )
    return f"""
    WITH sized AS (SELECT doc_id, md5('{settings.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest,
                          CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                          CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key FROM documents),
    classed AS (SELECT *, CAST(greatest(length(bin(size)) - 5, 0) AS INTEGER) AS k, k * 32 + (size >> k) AS class FROM sized),
    sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size,
                       [{weights}][1 + (row_number() OVER (ORDER BY source_key) - 1) % {len(settings.weights)}] AS weight,
                       CAST(sum(size) * {settings.most} AS DOUBLE) AS cap FROM classed GROUP BY source_key),
    ordered AS (SELECT *, (sum(source_size) OVER ()) * {share}::DOUBLE
                          - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS amount,
                       CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest_weight
                FROM sources WINDOW w AS (ORDER BY cap / weight, source_key)),
    level AS (SELECT max_by(amount, rest_weight) AS amount, max(rest_weight) AS rest_weight FROM ordered
              WHERE cap * rest_weight >= weight * amount),
    targets AS (SELECT o.source_key, o.source_size, least(o.weight * l.amount / l.rest_weight, o.cap) AS target,
                       {_unit(f"md5('{settings.seed}:' || substr(o.source_key, 2))")} AS start FROM ordered o, level l),
    kinds AS (SELECT source_key, class, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM classed GROUP BY ALL),
    phased AS (SELECT source_key, class, n, {phase} AS phase,
                      greatest({settings.rows_per_cell}, (sum(n) OVER () + {MAX_HEAVY_KEYS - 1}) // {MAX_HEAVY_KEYS}) AS per_cell
               FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY source_key ORDER BY class DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM kinds) JOIN targets USING (source_key)),
    placed AS (SELECT doc_id, size, source_key, phase,
                      CAST(row_number() OVER (PARTITION BY source_key, phase ORDER BY class DESC,
                           floor({_unit('digest')} * ceil(n / per_cell)), size, digest, doc_id NULLS FIRST) AS DOUBLE) AS position
               FROM classed JOIN phased USING (source_key, class)),
    totals AS (SELECT source_key, phase, count(*) AS n_phase, CAST(sum(size) AS BIGINT) AS words,
                      max(size) AS longest FROM placed GROUP BY ALL),
    state0 AS (SELECT source_key, target, source_size, target AS due, source_size AS rest, start FROM targets){steps},
    rates AS ({rates})
    SELECT doc_id, size, source_size, target, size * {copies} AS taken, rate AS expected, CAST({copies} AS INTEGER) AS copies
    FROM placed JOIN rates USING (source_key, phase)"""


def codes_sql(settings: codes.Settings = codes.Settings()) -> str:
    """Every part against every entry of its codebook."""
    steps = ""
    for k in range(settings.rounds + 1):
        steps += f""",
    near{k} AS (SELECT r, part, min(least_of) // 256 AS distance, min(least_of) % 256 AS entry FROM (
                  SELECT r, p.part, entry + 256 * CAST(list_sum(list_transform(list_zip(p.y, b.y),
                         lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS least_of
                  FROM parts p JOIN book{k} b USING (part)) GROUP BY r, part)"""
        if k < settings.rounds:
            steps += f""",
    mean{k} AS (SELECT part, entry, list(mean ORDER BY place) AS y FROM (
                  SELECT part, entry, place, CAST(floor(sum(y[place]) / count(*)) AS BIGINT) AS mean
                  FROM near{k} JOIN parts USING (r, part), range(1, (SELECT max(width) FROM parts) + 1) t(place)
                  GROUP BY part, entry, place) GROUP BY part, entry),
    book{k + 1} AS (SELECT part, entry, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
    last = settings.rounds
    return f"""
    WITH vectors AS MATERIALIZED (
      SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r,
             list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {settings.scale}) AS BIGINT)) AS x
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT r, part, len(x) // {settings.parts} AS width, x[part * width + 1 : part * width + width] AS y
              FROM vectors, range({settings.parts}) t(part)),
    book0 AS (SELECT part, r - 1 AS entry, y FROM parts WHERE r <= {settings.entries}){steps},
    digest AS (SELECT sha256(string_agg(list_aggregate(y, 'string_agg', ','), ',' ORDER BY part, entry)) AS sha FROM book{last}),
    coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
              FROM near{last} GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
    FROM coded JOIN vectors USING (r), digest"""
