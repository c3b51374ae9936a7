"""Page relations derived from the driver's tables, by text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table it is made of, SQL).
RELATIONS: dict[str, tuple[str, str]] = {
    "boxes": ("part", """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey * p_partkey * 7 + p_partkey * 13) % 400 AS BIGINT) AS x,
        CAST(((p_partkey * p_partkey * 3) % 97 * 11 + p_partkey * 29) % 300 AS BIGINT) AS y, CAST(20 + (p_size * 3) % 120 AS BIGINT) AS w, CAST(12 + (p_size * 7) % 40 AS BIGINT) AS h FROM part"""),
    "ticks": ("part", """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS grp, CAST(p_partkey AS BIGINT) AS seq, CAST((p_partkey % 8) * 1000 - 3000 AS DOUBLE) AS v,
        CAST(400 - (p_partkey % 8) * 50 + 150 + CASE WHEN p_size % 5 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS p FROM part"""),
    "labels2": ("part", """SELECT CAST(floor(p_partkey / 24) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(40 + p_partkey % 2 * 300 + p_size % 4 AS BIGINT) AS x, CAST(floor(p_partkey % 24 / 2) * 30 AS BIGINT) AS y, CAST(CASE WHEN p_size % 13 = 0 THEN 45 ELSE 20 + p_size % 5 END AS BIGINT) AS h,
        CASE WHEN p_size % 11 = 0 THEN p_name WHEN p_size % 7 = 0 THEN 'O' || CAST(p_partkey % 10 AS VARCHAR(9)) WHEN p_size % 17 = 0 THEN '1O' ELSE lpad(CAST(CAST(floor(p_partkey % 24 / 2) AS INT) + 1 + p_partkey % 2 * 4 AS VARCHAR(9)), 2, '0') END AS text FROM part"""),
    "arrow_lines": ("part", """SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 5 * 220 AS BIGINT) AS x, CAST(floor(p_partkey % 25 / 5) * 40 AS BIGINT) AS y, CAST(120 + p_size % 30 AS BIGINT) AS w, CAST(30 AS BIGINT) AS h, p_partkey % 3 <> 0 AS has_chars,
        CASE p_size % 9 WHEN 0 THEN p_name || '↑' WHEN 1 THEN '→' || p_name WHEN 2 THEN p_name || '一' WHEN 3 THEN '↑' WHEN 4 THEN substr(p_name, 1, 4) || '→' || substr(p_name, 5) WHEN 5 THEN '→' || p_name || '↓' WHEN 6 THEN p_name || '个' WHEN 7 THEN '↑↓' ELSE p_name END AS text FROM part"""),
    "arrow_regions": ("part", """SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, CAST(p_partkey * 2 AS BIGINT) AS id, CAST(p_partkey % 5 * 220 + 104 + p_size % 30 + p_size % 7 AS BIGINT) AS x, CAST(floor(p_partkey % 25 / 5) * 40 + p_size % 4 * 7 AS BIGINT) AS y, CAST(10 + p_size % 8 AS BIGINT) AS w, CAST(26 AS BIGINT) AS h FROM part WHERE p_partkey % 4 <> 0
        UNION ALL SELECT CAST(floor(p_partkey / 25) AS BIGINT), CAST(p_partkey * 2 + 1 AS BIGINT), CAST(p_partkey % 5 * 220 - 2 AS BIGINT), CAST(floor(p_partkey % 25 / 5) * 40 AS BIGINT), CAST(8 + p_size % 10 AS BIGINT), CAST(26 AS BIGINT) FROM part WHERE p_partkey % 5 < 3"""),
    "icons": ("part", """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey * p_partkey * 7 + p_partkey * 13) % 400 AS BIGINT) AS x, CAST(((p_partkey * p_partkey * 3) % 97 * 11 + p_partkey * 29) % 300 AS BIGINT) AS y, CAST(20 + (p_size * 3) % 120 AS BIGINT) AS w, CAST(12 + (p_size * 7) % 90 AS BIGINT) AS h,
        CAST(30 + p_size % 60 AS BIGINT) AS score, p_size % 19 = 0 AS pale, p_size % 7 = 0 AS light, CAST((20 + (p_size * 3) % 120) * (12 + (p_size * 7) % 90) * (60 + p_partkey % 41) / 100 AS BIGINT) AS fill, CAST(p_partkey % 90 AS BIGINT) AS rest, p_size % 3 * 60 AS r, 10 AS g, 0 AS b, p_partkey % 3 * 60 AS rest_r, 15 AS rest_g, 5 AS rest_b,
        p_partkey % 20 / CAST(50 AS DOUBLE) AS free, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 7 / CAST(6 AS DOUBLE) END AS drawn, p_partkey % 11 / CAST(10 AS DOUBLE) AS plain FROM part"""),
    "gap_lines": ("part", """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS x, CAST(22 * length(p_name) + 40 AS BIGINT) AS w, CAST(24 + p_partkey % 3 * 14 AS BIGINT) AS h, CASE p_partkey % 4 WHEN 0 THEN p_name || '05' WHEN 1 THEN translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') WHEN 2 THEN translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') || '（' || translate(lower(p_type), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') || '）' ELSE translate(substr(p_name, 1, 3), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') || '。ok' END AS text FROM part"""),
    "grade_lines": ("part", """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN q < 3 THEN 50 + p_size % 4 WHEN q < 6 THEN 60 + (q - 2) * 120 + p_size % 9 ELSE 50 + p_size * 9 END AS BIGINT) AS x, CAST(CASE WHEN q < 3 THEN 100 + q * 90 + p_size % 9 WHEN q < 6 THEN 350 + p_size % 5 ELSE 90 + p_size * 6 END AS BIGINT) AS y, CAST(30 AS BIGINT) AS w, CAST(18 + p_size % 6 AS BIGINT) AS h,
        CASE q WHEN 0 THEN '高' WHEN 1 THEN ' 中' WHEN 2 THEN '低' WHEN 3 THEN 'Low' WHEN 4 THEN 'Medium' WHEN 5 THEN 'High' ELSE CASE WHEN p_size % 9 = 0 THEN '高' ELSE p_name END END AS text FROM (SELECT p_partkey, p_size, p_name, p_partkey % 10 AS q FROM part)"""),
    "sheet_cells": ("orders", """SELECT page, r, c, r IN (0, 1, 14, 15, 16, 29) OR c % (16 + page % 2 * 9) = 0 OR noise % (6 + page % 3) = 0 AND page % 7 <> 3 AS pure FROM (SELECT CAST(floor(o_orderkey / 1500) AS BIGINT) AS page, CAST(floor(o_orderkey % 1500 / 50) AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c, CAST(o_custkey AS BIGINT) AS noise FROM orders)"""),
    "cards": ("part", """SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(48 + 210 * (p_partkey % 4) AS BIGINT) AS x, CAST(500 AS BIGINT) AS y, CAST(CASE WHEN floor(p_partkey / 4) % 2 = 0 THEN 180 ELSE 200 END AS BIGINT) AS w, CAST(56 AS BIGINT) AS h,
        CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS has_text, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS has_icon FROM part"""),
    "written": ("part", """SELECT *, CASE id % 7 WHEN 0 THEN replace(text, 'o', 'e') WHEN 1 THEN replace(replace(text, 'l', '1'), 'n', 'm') WHEN 2 THEN replace(text, substr(text, 3, 1), CAST(size AS VARCHAR(9))) WHEN 3 THEN text WHEN 4 THEN replace(text, ' ', '') WHEN 5 THEN '  ' || replace(text, 'i', 'oo') || ' ' END AS new
        FROM (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey * p_partkey * 7 + p_partkey * 13) % 400 AS BIGINT) AS x, CAST(((p_partkey * p_partkey * 3) % 97 * 11 + p_partkey * 29) % 300 AS BIGINT) AS y,
        CAST(20 + (p_size * 3) % 120 AS BIGINT) AS w, CAST(12 + (p_size * 7) % 40 AS BIGINT) AS h, p_size AS size, p_name || ' ' || lower(p_type) AS text FROM part)"""),
    "styled": ("part", """SELECT page, id, CASE WHEN size % 19 <> 0 THEN col * 130 + size % 5 END AS x0, y, y + 20 AS baseline, CAST(20 + size % 3 AS DOUBLE) AS size, CASE WHEN col = 2 THEN 180 ELSE 10 END AS r, size % 4 * 8 AS g, 0 AS b, size % 3 = 0 AS bold, size % 6 = 0 AS heavy,
        CASE WHEN col = 1 THEN 'serif' ELSE 'sans' END AS family, CAST((20 + size % 3) * (10 + size % 5 * 0.4) / 100 AS DOUBLE) AS stroke, text, size % 13 = 0 AS badge, CASE WHEN size % 11 = 0 THEN 2 ELSE 1 END AS n_runs FROM (SELECT *, CAST(nr * 26 + CASE col WHEN 1 THEN floor(nr / 2) * 40 WHEN 2 THEN floor(nr / 4) * 50 ELSE 0 END AS BIGINT) AS y
        FROM (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, p_partkey % 50 % 3 AS col, floor(p_partkey % 50 / 3) AS nr, p_size AS size, p_name AS text FROM part))"""),
    "accent_lines": ("part", """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size % 17 <> 0 THEN CAST(p_partkey % 2 * 300 + p_size % 4 AS BIGINT) END AS x0, CAST(floor(p_partkey % 50 / 2) * 30 AS BIGINT) AS y, CAST(floor(p_partkey % 50 / 2) * 30 + 20 + p_size % 2 AS BIGINT) AS baseline,
        CAST(20 + p_size % 3 AS DOUBLE) AS size, p_size % 23 = 0 AS badge, p_size % 5 <> 0 AS has_runs FROM part"""),
    "accent_runs": ("part", """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, k, text, r, g, b, bold, CAST(20 AS DOUBLE) AS px, CASE WHEN p_size % 9 <> 0 THEN CAST(2 + p_size % 5 * 0.25 + k * 0.2 AS DOUBLE) END AS stroke FROM (
        SELECT p_partkey, p_size, 0 AS k, translate(substr(p_name, 1, 2 + p_size % 3), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') AS text, CASE p_size % 4 WHEN 0 THEN 200 WHEN 1 THEN 205 ELSE 10 END AS r, CASE p_size % 4 WHEN 0 THEN 20 WHEN 1 THEN 30 ELSE 10 END AS g, CASE p_size % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 + p_size % 40 ELSE 10 END AS b, p_size % 7 = 0 AS bold FROM part
        UNION ALL SELECT p_partkey, p_size, 1, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') || CASE WHEN p_size % 6 = 0 THEN '。 ' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 20 ELSE 10 END, 20, CASE p_partkey % 5 WHEN 0 THEN 20 + p_size WHEN 1 THEN 200 ELSE 12 END, p_size % 10 = 0 FROM part WHERE p_partkey % 3 >= 1 AND p_size % 5 <> 0
        UNION ALL SELECT p_partkey, p_size, 2, translate(lower(p_type), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到'), CASE WHEN p_size % 3 = 0 THEN 210 ELSE 12 END, CASE WHEN p_size % 3 = 0 THEN 25 ELSE 10 END, CASE WHEN p_size % 3 = 0 THEN 15 + p_partkey % 30 ELSE 10 END, false FROM part WHERE p_partkey % 3 = 2 AND p_size % 5 <> 0)"""),
    "mark_lines": ("part", """SELECT page, id, CASE WHEN size % 19 > 0 THEN x0 END AS x0, y0, CASE WHEN size % 19 > 0 THEN x1 END AS x1, y0 + 14 + id % 6 AS y1, CAST(9 + size % 12 AS DOUBLE) AS size, text, size % 17 = 0 AS badge, size % 3 * 20 AS r, 10 AS g, 0 AS b FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1,
        CASE p_size % 7 WHEN 0 THEN p_name WHEN 1 THEN '一' || translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') WHEN 2 THEN translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') || '。' WHEN 3 THEN '“' || translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') ELSE translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '的一是在不了有和人这中大为上个国我以要他时来用们生到') END AS text FROM part)"""),
    "strokes": ("part", """SELECT page, CAST(id AS BIGINT) AS id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, size % 3 * 20 + id % 7 * 12 AS r, 10 AS g, 0 AS b, size % 10 = 0 AS taken, size % 9 > 0 AS alone FROM (
        SELECT page, p * 4 AS id, x0 - 8 - p % 11 - size % 34 AS x, y0 + 6 + p % 3 AS y, 6 + size % 34 AS w, 1 + size % 5 AS h, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part)
        UNION ALL SELECT page, p * 4 + 1, x0 - 24 - p % 11 - size % 34, y0 + 6 + size % 4, 12, 2, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part) WHERE p % 3 = 0
        UNION ALL SELECT page, p * 4 + 2, x1 + 3 + size % 14, y0 + 7, 8 + p * 7 % 60, 2, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part) WHERE p % 4 < 2)"""),
    "spots": ("part", """SELECT page, CAST(id AS BIGINT) AS id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, size % 3 * 20 + id % 7 * 13 AS r, 10 AS g, 0 AS b, size % 10 = 0 AS taken, size % 8 = 0 AS stem, CAST(floor(w * h * (4 + id % 7) / 10) AS BIGINT) AS area FROM (
        SELECT page, p * 5 AS id, x1 + 1 + size % 9 AS x, y0 + 4 + p % 14 AS y, 1 + size % 6 AS w, 1 + p % 8 AS h, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part)
        UNION ALL SELECT page, p * 5 + 1, x1 + 4 + p % 4, y0 + 12, 4, 4, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part) WHERE p % 2 = 0
        UNION ALL SELECT page, p * 5 + 2, x1 + 2, y0 + size % 4, 2, 4, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part) WHERE p % 3 < 2
        UNION ALL SELECT page, p * 5 + 3, x1 + 5 + size % 3, y0 + 1, 3, 4, size FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, p_partkey AS p, p_size AS size, CAST(60 + p_partkey % 5 * 300 AS BIGINT) AS x0, CAST(20 + floor(p_partkey % 25 / 5) * 60 AS BIGINT) AS y0, CAST(160 + p_partkey % 5 * 300 + p_size % 10 AS BIGINT) AS x1 FROM part) WHERE p % 5 < 2)"""),
    "glyph_lines": ("part", """SELECT *, b1 + 1 + size % 6 AS a2, b1 + 7 + size % 6 + id % 5 AS b2, b1 + 9 + size % 6 + id % 5 + id % 12 AS a3 FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, p_size AS size, CAST(p_size AS BIGINT) AS x, CAST(300 + p_size AS BIGINT) AS w, CAST(20 AS BIGINT) AS h, p_size % 13 = 0 AS manual, p_size % 3 AS a1, p_size % 3 + 5 + p_partkey % 9 AS b1,
        CASE p_size % 5 WHEN 0 THEN '品 ' || p_name WHEN 1 THEN '口' || p_name WHEN 2 THEN '■ a' WHEN 3 THEN '田  ' || p_name ELSE '□ ' || p_type END AS text FROM part)"""),
    "bar_lines": ("part", """SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS x, CAST(20 * length(p_name) + 60 AS BIGINT) AS w, CAST(22 AS BIGINT) AS h, CASE p_size % 5 WHEN 0 THEN '▌' || p_name WHEN 1 THEN '1 ' || p_name WHEN 2 THEN 'K1' || p_name WHEN 3 THEN substr(p_name, 1, 4) || '|' || substr(p_name, 5) ELSE '丨' || p_name || ' I' END AS text FROM part"""),
    "tall_lines": ("part", """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 10 * 60 AS BIGINT) AS x, CAST(p_size % 3 * 10 AS BIGINT) AS y, CAST(40 AS BIGINT) AS w, CAST(50 + p_size % 40 AS BIGINT) AS h, CAST(0.7 + p_size % 5 * 0.06 AS DOUBLE) AS score,
        CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'A的' WHEN 2 THEN '的' WHEN 3 THEN 'ab' WHEN 4 THEN p_name ELSE '的是A' END AS text FROM part"""),
    "strip_reads": ("part", """SELECT page, p AS line, CAST(k AS INT) AS band, CAST(p * 4 + k AS BIGINT) AS seq, CAST(p % 10 * 60 + k * 9 AS BIGINT) AS x, CAST(k * 20 AS BIGINT) AS y, CAST(30 AS BIGINT) AS w, CAST(18 AS BIGINT) AS h, CASE (p + p_size + k) % 4 WHEN 0 THEN '的' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '是在' ELSE '的' END WHEN 2 THEN 'A' ELSE '的' END AS text, CAST((p_size * (k + 1)) % 7 AS BIGINT) AS score
        FROM (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS p, p_size FROM part) CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE (p * 3 + k + p_size) % 5 < 3"""),
    "turns": ("conversations", """SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE role END AS role, CAST(length(text) % 2 AS INT) AS bit, length(text) % 4 = 0 AS flag, CAST(length(text) AS BIGINT) AS n FROM conversations"""),
    "votes": ("events", """SELECT CAST(user_id AS BIGINT) AS grp, event_type AS choice, CAST(value AS DOUBLE) AS score, CAST(event_id AS BIGINT) AS seq FROM events"""),
    "history": ("events", """SELECT event_type AS kind, CAST(event_id AS BIGINT) AS seq, CAST(event_id % 1000 AS BIGINT) AS t, CAST(1 + event_id % 9 AS BIGINT) AS total, CAST(event_id % 9 % 4 AS BIGINT) AS changed FROM events"""),
    "jobs": ("events", """SELECT CAST(user_id AS BIGINT) AS job, CAST(event_id AS BIGINT) AS seq, CAST(event_id % 7919 AS DOUBLE) AS t,
        CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'error' END AS state, CAST(user_id % 5 AS BIGINT) AS shard, event_type AS stage, CAST(event_id % 100 AS BIGINT) AS data FROM events"""),
    "samples": ("embeddings", """SELECT CAST(vec_id AS BIGINT) AS seq, CAST(vec_id % 97 AS DOUBLE) AS t, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS keep, CAST(1.0 / (1 + vec_id % 3) AS DOUBLE) AS w,
        CASE WHEN vec_id % 4 = 0 THEN 'implicit' ELSE 'edit' END AS src FROM embeddings"""),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = RELATIONS[name]
    return spark.sql(sql.replace("VARCHAR(9)", "STRING").replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def with_(*names: str) -> str:
    """A WITH clause of these relations for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS (SELECT * FROM ({RELATIONS[n][1]}))" for n in names)
