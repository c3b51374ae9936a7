"""Queries of weights and colours of lines and runs that belong together, and their SQL."""

from __future__ import annotations

from ..operators import styles
from .queries import query
from .relations import relation, with_

# A chain goes from a line to the first free one below it that fits; m holds each line's followers in order. Every step of f
# adds a line to the page's chain, or ends the chain and goes on to the next line.
_CHAINS = f"""{with_('styled')}, l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, y, id) AS k, row_number() OVER (PARTITION BY page ORDER BY y, x0, id) AS pos FROM styled WHERE NOT badge AND x0 IS NOT NULL AND n_runs <= 1),
  m AS MATERIALIZED (SELECT page, id, coalesce(list({{'id': b, 'pos': pos}} ORDER BY pos) FILTER (b IS NOT NULL), []) AS after FROM (SELECT a.page, a.id, b.id AS b, b.pos FROM l a LEFT JOIN l b ON a.page = b.page AND b.y > a.y AND abs(b.x0 - a.x0) < CAST(0.6 AS DOUBLE) * a.size AND abs(b.size - a.size) < CAST(0.15 AS DOUBLE) * a.size
    AND abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) < 90 AND b.baseline - a.baseline < CAST(2.2 AS DOUBLE) * a.size) GROUP BY ALL),
  w AS MATERIALIZED (SELECT page, list({{'id': id, 'n': length(text), 'bold': bold, 'serif': family = 'serif', 'stroke': stroke / greatest(1.0, size)}}) AS all_ FROM l GROUP BY page),
  f AS (SELECT page, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS chain, CAST([] AS BIGINT[]) AS used, CAST([] AS STRUCT(id BIGINT, bold BOOLEAN, regular BOOLEAN)[]) AS said FROM (SELECT DISTINCT page FROM l)
    UNION ALL SELECT page, CASE WHEN len(chain) = 0 AND NOT free OR len(chain) > 0 AND nxt IS NULL THEN k + 1 ELSE k END, CASE WHEN nxt IS NULL THEN 0 ELSE nxt.pos END, CASE WHEN len(chain) = 0 AND free THEN [a] WHEN len(chain) > 0 AND nxt IS NOT NULL THEN list_append(chain, nxt.id) ELSE [] END,
      CASE WHEN len(chain) > 0 AND nxt IS NULL AND (two OR len(chain) >= 3) THEN list_concat(used, chain) ELSE used END,
      CASE WHEN len(chain) > 0 AND nxt IS NULL AND two THEN list_concat(said, list_transform(chain, lambda i: {{'id': i, 'bold': false, 'regular': true}}))
        WHEN len(chain) >= 3 AND nxt IS NULL AND (nb * 3 >= nt * 2 OR nb * 3 <= nt) THEN list_concat(said, list_transform(chain, lambda i: {{'id': i, 'bold': nb * 3 >= nt * 2, 'regular': false}})) ELSE said END
    FROM (SELECT *, NOT list_contains(used, a) AS free, list_sum(list_transform(own, lambda o: o.n)) AS nt, coalesce(list_sum(list_transform(list_filter(own, lambda o: o.bold), lambda o: o.n)), 0) AS nb,
        len(chain) = 2 AND len(list_filter(own, lambda o: o.bold)) = 1 AND len(list_filter(own, lambda o: NOT o.serif)) = 0 AND list_min(list_transform(own, lambda o: o.stroke)) > 0 AND list_max(list_transform(own, lambda o: o.stroke)) < CAST(1.15 AS DOUBLE) * list_min(list_transform(own, lambda o: o.stroke)) AS two
      FROM (SELECT f.*, l.id AS a, list_filter(w.all_, lambda o: list_contains(f.chain, o.id)) AS own, CASE WHEN len(f.chain) > 0 THEN list_filter(m.after, lambda s: s.pos > f.pos AND NOT list_contains(f.used, s.id) AND s.id <> f.chain[1])[1] END AS nxt
        FROM f JOIN l ON l.page = f.page AND l.k = f.k JOIN w ON w.page = f.page LEFT JOIN m ON m.page = f.page AND m.id = f.chain[len(f.chain)]))),
  d AS (SELECT page, s.id, s.bold, s.regular FROM (SELECT page, unnest(said) AS s FROM (SELECT page, said FROM f WHERE len(chain) = 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)))"""


@query(f"""{_CHAINS} SELECT s.page, s.id, coalesce(d.bold, s.bold) AS bold, s.heavy AND NOT coalesce(d.regular, false) AS heavy FROM styled s LEFT JOIN d ON d.page = s.page AND d.id = s.id""")
def bold_harmony(spark, sf_dir):
    return styles.harmonised_bold(relation(spark, sf_dir, "styled"))


def _apart(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "rgb")


@query(rf"""{with_('accent_lines', 'accent_runs')}, c AS MATERIALIZED (SELECT x.*, length(regexp_replace(x.text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS cjk, l.badge, l.has_runs, count(*) OVER (PARTITION BY x.id) AS n, count(x.stroke) OVER (PARTITION BY x.id) AS strokes FROM accent_runs x JOIN accent_lines l ON l.id = x.id),
  e AS (SELECT page, r, g, b, sum(cjk) AS n, min(id * 10 + k) AS head FROM c GROUP BY ALL),
  body AS (SELECT page, r, g, b FROM (SELECT a.page, a.r, a.g, a.b, a.head, sum(b.n) AS n FROM e a JOIN e b ON a.page = b.page AND {_apart('a', 'b')} < 3600 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, head) = 1),
  base AS (SELECT c.* FROM c JOIN body p ON c.page = p.page WHERE has_runs AND NOT badge AND n >= 2 QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY {_apart('c', 'p')}, k) = 1),
  acc AS MATERIALIZED (SELECT c.*, c.bold OR coalesce(c.strokes = c.n AND s.stroke > 0 AND c.stroke > 0 AND (c.stroke / c.px) / (s.stroke / s.px) >= CAST(1.2 AS DOUBLE), false) AS clear FROM c JOIN base s ON s.id = c.id AND c.k <> s.k AND {_apart('c', 's')} >= 3600 WHERE c.cjk > 0),
  above AS (SELECT a.id, b.id AS prev FROM accent_lines a JOIN acc x ON x.id = a.id AND x.k = 0 JOIN accent_lines b ON b.page = a.page AND b.has_runs AND b.x0 IS NOT NULL AND a.baseline > b.baseline AND a.baseline - b.baseline < CAST(2.2 AS DOUBLE) * a.size AND abs(a.x0 - b.x0) < CAST(0.8 AS DOUBLE) * a.size
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.baseline DESC, b.y, b.id) = 1),
  link AS MATERIALIZED (SELECT o.id, p.id AS prev, p.k AS pk FROM above o JOIN acc x ON x.id = o.id AND x.k = 0 JOIN c p ON p.id = o.prev AND p.k = p.n - 1 WHERE p.cjk > 0 AND (p.n = 1 OR EXISTS (SELECT 1 FROM acc y WHERE y.id = p.id AND y.k = p.k)) AND {_apart('p', 'x')} < 8100 AND NOT regexp_matches(rtrim(p.text), '[。；！？;!?：:]$')),
  i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id, k) AS o FROM acc WHERE cjk <= 12 AND NOT (k = 0 AND id IN (SELECT id FROM link))),
  f AS (SELECT page, CAST(0 AS BIGINT) AS o, CAST([] AS STRUCT(r INT, g INT, b INT)[]) AS firsts, CAST(0 AS BIGINT) AS grp FROM (SELECT DISTINCT page FROM i)
    UNION ALL SELECT page, o, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(firsts, own) ELSE firsts END, CASE WHEN hit IS NULL OR hit = 0 THEN len(firsts) + 1 ELSE hit END FROM (
      SELECT f.page, i.o, f.firsts, {{'r': i.r, 'g': i.g, 'b': i.b}} AS own, list_position(list_transform(f.firsts, lambda z: {_apart('z', 'i')} < 8100), true) AS hit FROM f JOIN i ON i.page = f.page AND i.o = f.o + 1)),
  grp AS (SELECT i.id, i.k, max(clear) OVER w AS clear, first_value(r) OVER v AS r, first_value(g) OVER v AS g, first_value(b) OVER v AS b FROM i JOIN f ON f.page = i.page AND f.o = i.o WINDOW w AS (PARTITION BY i.page, f.grp), v AS (PARTITION BY i.page, f.grp ORDER BY greatest(r, g, b) - least(r, g, b) DESC, i.o)),
  done AS MATERIALIZED (SELECT c.page, c.id, c.k, coalesce(x.r, c.r) AS r, coalesce(x.g, c.g) AS g, coalesce(x.b, c.b) AS b, c.bold OR coalesce(x.clear, false) AS bold FROM c LEFT JOIN grp x ON x.id = c.id AND x.k = c.k)
SELECT d.page, d.id, d.k, coalesce(p.r, d.r) AS r, coalesce(p.g, d.g) AS g, coalesce(p.b, d.b) AS b, coalesce(p.bold, d.bold) AS bold FROM done d LEFT JOIN link ON d.k = 0 AND link.id = d.id LEFT JOIN done p ON p.id = link.prev AND p.k = link.pk""")
def accent_harmony(spark, sf_dir):
    return styles.harmonised_accents(relation(spark, sf_dir, "accent_lines"), relation(spark, sf_dir, "accent_runs"))
