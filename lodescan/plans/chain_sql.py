"""The whole chain from candidates to findings in SQL, after CTEs ``base``, ``policy``, ``words`` and ``hinted``."""

CHAIN = """
, open AS (SELECT b.*, y.* EXCLUDE (detector), CASE WHEN validated THEN ['checksum'] ELSE ['shape'] END AS ev FROM base b JOIN policy y USING (detector) JOIN words w ON w.name = b.col
    LEFT JOIN hinted h ON h.name = b.col AND h.detector = b.detector
    WHERE h.detector IS NOT NULL OR NOT coalesce(regexp_matches(w.words, negative_fields), false)),
capped AS (SELECT * EXCLUDE (tier, ev), CASE WHEN context = 'required' AND tier > 0 AND NOT validated THEN 0 ELSE tier END AS tier,
    CASE WHEN context = 'required' AND tier > 0 AND NOT validated THEN list_append(ev, 'uncorroborated') ELSE ev END AS ev FROM open),
known_ids AS (SELECT unit_id, record_ix, scope, list(DISTINCT detector) AS ids FROM capped WHERE identity AND tier >= 1 GROUP BY ALL),
lifted AS (SELECT c.*, tier >= 1 AS independent, tier = 0 AND corroborated AND coalesce(len(ids), 0) >= 2 AND NOT coalesce(list_contains(ids, detector), false) AS up
    FROM capped c LEFT JOIN known_ids k ON k.unit_id IS NOT DISTINCT FROM c.unit_id AND k.record_ix = c.record_ix AND k.scope = c.scope),
hits AS (SELECT * EXCLUDE (tier, ev), CASE WHEN up THEN 1 ELSE tier END AS tier, CASE WHEN up THEN list_append(ev, 'record:identity') ELSE ev END AS ev FROM lifted),
cellwise AS (SELECT unit_id, col, detector, cell_id, max(tier) AS tier, bool_or(validated) AS validated, min(seq) AS seq FROM hits GROUP BY ALL),
profile AS (SELECT a.*, v.distinct_values FROM (SELECT unit_id, col, detector, count(*) AS matches, sum(validated::INT) AS validated, count_if(tier = 1) AS t1, count_if(tier = 2) AS t2, min(seq) AS first_seq
      FROM cellwise GROUP BY ALL) a JOIN (SELECT unit_id, col, detector, count(DISTINCT value) AS distinct_values FROM hits GROUP BY ALL) v USING (unit_id, col, detector)),
sampled AS (SELECT unit_id, col, count(DISTINCT cell_id) AS sampled FROM base GROUP BY ALL),
share AS (SELECT p.*, s.sampled, (CASE WHEN y.needs_validation THEN p.validated ELSE p.matches END) / s.sampled AS ratio, y.* EXCLUDE (detector) FROM profile p JOIN sampled s USING (unit_id, col) JOIN policy y USING (detector)),
verdict AS (SELECT *, column_classify AND matches >= column_min_matches AND distinct_values >= column_min_matches AND ratio >= column_ratio AS classified,
    least(2, 1 + CASE WHEN t2 * 2 >= matches THEN 2 WHEN (t2 + t1) * 2 >= matches THEN 1 ELSE 0 END) AS raised FROM share),
owners AS (SELECT unit_id, col, detector AS owner FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, col ORDER BY (validated / sampled >= 0.5) DESC, ratio DESC, validated DESC, first_seq) AS rn
    FROM verdict WHERE classified) WHERE rn = 1),
j AS (SELECT r.*, o.owner, coalesce(v.validated / v.sampled, 0) >= 0.2 AS proof FROM hits r LEFT JOIN owners o USING (unit_id, col) LEFT JOIN verdict v USING (unit_id, col, detector)),
kept AS (SELECT * FROM j WHERE owner IS NULL OR owner = detector OR (proof AND tier = 2) OR (independent AND NOT EXISTS (SELECT 1 FROM j o WHERE o.unit_id = j.unit_id AND o.cell_id = j.cell_id
    AND o.col = j.col AND o.detector = j.owner AND least(o.end_ix, j.end_ix) - greatest(o.start_ix, j.start_ix) > 0
    AND (least(o.end_ix, j.end_ix) - greatest(o.start_ix, j.start_ix)) / greatest(1, j.end_ix - j.start_ix) >= 0.8))),
parents AS (SELECT DISTINCT unit_id, col, CASE WHEN contains(col, '.') THEN regexp_extract(col, '^(.*)[.][^.]*$', 1) ELSE '' END AS parent FROM base),
sibling AS (SELECT m.unit_id, m.col, m.detector, list_sort(list(DISTINCT o.col)) AS names FROM (SELECT DISTINCT unit_id, col, detector, siblings FROM hits WHERE siblings IS NOT NULL) m
    JOIN parents p ON p.unit_id = m.unit_id AND p.col = m.col JOIN parents o ON o.unit_id = m.unit_id AND o.parent = p.parent AND o.col <> m.col
    JOIN words w ON w.name = o.col WHERE regexp_matches(w.words, m.siblings) GROUP BY ALL),
judged AS (SELECT k.*, v.ratio, CASE WHEN v.classified THEN least(2, v.raised + CASE WHEN s.names IS NULL THEN 0 ELSE 1 END) END AS verdict_tier, s.names
    FROM kept k LEFT JOIN verdict v USING (unit_id, col, detector) LEFT JOIN sibling s USING (unit_id, col, detector)),
counts AS (SELECT unit_id, col, detector, count(DISTINCT value) AS n FROM judged WHERE verdict_tier IS NULL AND tier = 0 AND context <> 'none' AND count_promotion GROUP BY ALL),
promoted AS (SELECT g.unit_id, g.col, g.detector, g.category, g.value, g.location, g.seq,
    CASE WHEN verdict_tier IS NOT NULL THEN greatest(tier, verdict_tier) WHEN tier = 0 AND context <> 'none' AND count_promotion AND n >= min_count THEN 1 ELSE tier END AS tier,
    CASE WHEN verdict_tier IS NOT NULL THEN list_concat(ev, list_concat(['column:' || printf('%.2f', round(ratio, 2))], CASE WHEN names IS NULL THEN [] ELSE ['siblings:' || array_to_string(names[1:3], ',')] END))
      WHEN tier = 0 AND context <> 'none' AND count_promotion AND n >= min_count THEN list_append(ev, 'count:' || n) ELSE ev END AS ev
    FROM judged g LEFT JOIN counts c USING (unit_id, col, detector)),
likely AS (SELECT * FROM promoted WHERE tier >= 1),
many AS (SELECT unit_id, col, detector, count(*) AS occurrences, max(tier) AS tier, arg_min(value, seq) AS value, min(seq) AS seq FROM likely GROUP BY ALL HAVING count(*) >= 25),
lists AS (SELECT unit_id, col, detector, flatten(list(ev ORDER BY s)) AS ev FROM (SELECT unit_id, col, detector, ev, min(seq) AS s FROM likely GROUP BY ALL) GROUP BY ALL),
merged AS (SELECT unit_id, col, detector, array_to_string(list_filter(ev, lambda e, i: list_position(ev, e) = i), ',') AS evidence FROM lists),
found AS (
  SELECT unit_id, col, detector, tier, value, 'Column ' || chr(39) || col || chr(39) || ' (' || occurrences || ' matches)' AS location, true AS aggregated, occurrences, evidence, seq FROM many JOIN merged USING (unit_id, col, detector)
  UNION ALL SELECT unit_id, col, detector, tier, value, location, false, NULL, array_to_string(ev, ','), seq FROM likely l
    WHERE NOT EXISTS (SELECT 1 FROM many g WHERE g.unit_id = l.unit_id AND g.col = l.col AND g.detector = l.detector))
SELECT unit_id, col AS "column", detector, CASE tier WHEN 1 THEN 'likely' WHEN 2 THEN 'very_likely' END AS tier, location, aggregated, occurrences, evidence
FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, detector, value, location ORDER BY seq) AS rn FROM found) WHERE rn = 1"""
