"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules

WORD = r"[^\x20\x09-\x0D]+"

SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, j, substring(h, 400 * j + 1, 798) AS h FROM (SELECT r, h, unnest(range(0, (len(h) // 2 + 200) // 200)) AS j FROM d)),
w AS (SELECT r, 200 * j + i AS i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT r, j, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM p)),
f AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g),
spans AS (SELECT r, n, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY r, n),
gaps AS (SELECT d.r, x.a, x.b, coalesce(lag(x.b) OVER (PARTITION BY d.r ORDER BY x.a), 0) AS p, h FROM d JOIN spans x ON d.r = x.r),
kept AS (SELECT r, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS k, sum(b - a)::bigint AS gone, count(*) AS n FROM gaps GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS k FROM (SELECT *, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM d)),
f AS (SELECT w.r, w.i FROM w JOIN (SELECT k, min(doc_id) AS least FROM w GROUP BY k) m ON w.k = m.k WHERE least < w.doc_id),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 13)) AS i FROM f),
each AS (SELECT r, i, words[i] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
kept AS (SELECT each.r, string_agg(word, ' ' ORDER BY each.i) AS k, count(*) AS n FROM each ANTI JOIN gone ON each.r = gone.r AND each.i = gone.i GROUP BY each.r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""

TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM s) WHERE rank <= 10
"""


def quality() -> str:
    rules = quality_rules
    low = lambda b, k: f"(({b} - greatest({b} // {k} - 1, 0) * {k})::bigint << greatest({b} // {k} - 1, 0)::int)"
    high = lambda b, k: f"({low(b, k)} + (1::bigint << greatest({b} // {k} - 1, 0)::int) - 1)"
    to_bin = lambda v, bits: f"(greatest(len(bin({v})) - {bits}, 0) * {1 << (bits - 1)} + ({v} >> greatest(len(bin({v})) - {bits}, 0)::int))::int"

    def level(name: str, by: list[str]) -> str:
        keys = "".join(f"{c}, " for c in by)
        same = "".join(f" AND y.{c} IS NOT DISTINCT FROM x.{c}" for c in by)
        found = []
        for r in rules.GAP:
            k, bits, gap = 1 << (rules.BITS[r] - 1), rules.BITS[r], float(rules.GAP[r])
            far = to_bin(f"floor(({high('bin', k)} + 1) * {gap})::bigint", bits)
            found.append((f"high_{r}", r, f"SELECT *, {far} AS far FROM {name}1 WHERE rate = '{r}' AND seen * 4 >= total * 3", "y.bin > x.bin AND y.bin < x.far", high("min(bin)", k)))
            if r in rules.BOTH:
                far = to_bin(f"floor({low('bin', k)} / {gap})::bigint", bits)
                found.append((f"low_{r}", r, f"SELECT *, {far} AS far FROM {name}1 WHERE rate = '{r}' AND (seen - n) * 4 <= total", "y.bin < x.bin AND y.bin > x.far", low("max(bin)", k)))
        parts = [
            f"SELECT {keys}'{limit}' AS name, max(total) AS docs, {value} AS edge FROM ({rows}) x WHERE (SELECT coalesce(sum(y.n), 0) FROM {name}1 y WHERE y.rate = '{r}'{same} AND {there}) * {rules.STRAYS} <= total {'GROUP BY ' + ', '.join(by) if by else ''}"
            for limit, r, rows, there, value in found
        ]
        edges = ", ".join(f"max(edge) FILTER (name = '{x}') AS {x}" for x in rules.LIMITS)
        part = f"PARTITION BY {keys}rate"
        return f"""{name}1 AS (SELECT *, sum(n) OVER ({part})::bigint AS total, sum(n) OVER ({part} ORDER BY bin)::bigint AS seen FROM (SELECT {keys}rate, bin, sum(n)::bigint AS n FROM sketch GROUP BY {keys}rate, bin)),
{name} AS (SELECT {keys}max(docs) AS docs, {edges} FROM ({' UNION ALL '.join(parts)}) {'GROUP BY ' + ', '.join(by) if by else ''})"""

    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {to_bin(r, rules.BITS[r])} AS bin FROM rated WHERE NOT base_failed" for r in rules.GAP)
    pick = lambda x: f"CASE WHEN a.docs >= {rules.LEAST} THEN a.{x} WHEN b.docs >= {rules.LEAST} THEN b.{x} ELSE c.{x} END"
    fine = " AND ".join([f"{r} <= {pick('high_' + r)}" for r in rules.GAP] + [f"{r} >= {pick('low_' + r)}" for r in rules.BOTH])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
w AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM d)),
p AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM w) WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON d.r = p.r),
rated AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS r_chars, 1000 * n_symbols // greatest(n_words, 1) AS r_symbols, 1000 * n_dup_lines // greatest(n_words, 1) AS r_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS r_repeats,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
sketch AS (SELECT lang, source, rate, bin, count(*) AS n FROM ({long}) GROUP BY ALL),
{level('a', ['lang', 'source'])}, {level('b', ['lang'])}, {level('c', [])},
j AS (SELECT rated.*, {fine} AS fine
      FROM rated LEFT JOIN a ON a.lang IS NOT DISTINCT FROM rated.lang AND a.source IS NOT DISTINCT FROM rated.source LEFT JOIN b ON b.lang IS NOT DISTINCT FROM rated.lang CROSS JOIN c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept FROM j
"""


def mixture() -> str:
    weights = f"[{', '.join(str(float(w)) for w in mixing.WEIGHTS)}]"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, text,
           (('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 13))::bigint::double + 1.0) / 4503599627370497.0 AS u FROM documents),
e AS (SELECT *, -ln(u) / (1.0 / (1.0 + 10.0 * coalesce(length(text) - length(translate(text, '{mixing.SYMBOLS}', '')), 0) / greatest(size, 1))) AS k FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::double AS w, ({mixing.MOST} * source_size)::double AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::double - coalesce(sum(cap) OVER past, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER past, 0)) AS level
      FROM w WINDOW past AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * w <= cap AS free, arg_min(level, cap / w) FILTER (level * w <= cap) OVER () AS last FROM l),
t AS (SELECT source, source_size, CASE WHEN free THEN least(cap, last * w) ELSE cap END AS target FROM f),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS epochs,
      coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS past
      FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::bigint - epochs * source_size - past)))::bigint AS taken FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": SUFFIX, "op3_quality_rules": quality(), "op7_substring_dedup": SUBSTRING, "op9_mixing": mixture(), "op10_topk": TOP}
