"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .licenses import op2_license_scan
from .lines import op6_line_dedup
from .lm import op5_lm_scores
from .mixing import op4_mix_sources
from .neardup import op1_near_duplicates
from .packing import op10_packing
from .phrases import op13_phrase_collocations
from .quality import op9_quality_rules
from .resampling import op11_importance_resampling
from .secrets import op8_secret_scan
from .substrings import op3_substring_dedup
from .suffixes import op12_suffix_dedup
from .vectors import op7_embedding_links


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_license_scan, op3_substring_dedup, op4_mix_sources, op5_lm_scores, op6_line_dedup, op7_embedding_links, op8_secret_scan, op9_quality_rules, op10_packing, op11_importance_resampling, op12_suffix_dedup, op13_phrase_collocations, pipeline)}

# A blank is one of space and \t \n \v \f \r. [^...]+ are words.
_BLANK = r"\x20\x09-\x0D"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op11_importance_resampling": f"""
        WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
        goal AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
        spelt AS (SELECT w, hex(w) AS x FROM (SELECT w FROM words UNION SELECT w FROM goal)),
        hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM spelt, steps),
        s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b),
        t AS (SELECT b, count(*) AS n FROM goal JOIN hashed USING (w) GROUP BY b),
        gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
        weighed AS (SELECT doc_id, count(*) AS n, sum(g) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM documents d LEFT JOIN weighed USING (doc_id)),
        drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_rows FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * all_rows // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)""",
    "op6_line_dedup": f"""
        WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_STRIP})")} AS k FROM split),
        frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id""",
    "op3_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS words FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM starts JOIN w USING (doc_id)),
        least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (h) WHERE d < doc_id),
        placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
        kept AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op13_phrase_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
        totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
        grams AS (SELECT lang, words[i:i + k - 1] AS g FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) r(k))),
        f AS (SELECT lang, g, count(*)::BIGINT AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30),
        cuts AS (SELECT f.lang, f.g, f.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a // (x.a + y.a))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f) f JOIN f x ON x.lang = f.lang AND x.g = f.g[1:k] JOIN f y ON y.lang = f.lang AND y.g = f.g[k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inside AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, range(2, 4) r(k) WHERE k < len(g)) GROUP BY ALL),
        named AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op12_suffix_dedup": """
        WITH x AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
        starts AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 399)) AS i FROM x WHERE length(x) >= 800),
        w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM starts JOIN x USING (doc_id)),
        gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        grouped AS (SELECT *, sum(CASE WHEN i <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS e FROM grouped GROUP BY doc_id, g),
        gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
        kept AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(e) + 1) AS k FROM gaps JOIN x USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
        FROM x LEFT JOIN kept USING (doc_id)""",
    "op4_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+'))::BIGINT AS size, ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
        l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER below, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
            FROM s WINDOW below AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
        q AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, (run + k * source_size)::DOUBLE / target AS finish FROM q, range(2) r(k) WHERE size > 0),
        o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS through FROM p),
        g AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT floor(1.5::DOUBLE * sum(source_size)) FROM t) - (through - size))))::BIGINT AS taken FROM o GROUP BY doc_id)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (doc_id)""",
    "op1_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^{_BLANK}]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id, least = d.doc_id AS kept
        FROM documents d JOIN (SELECT d AS doc_id, min(r) AS least FROM reach GROUP BY d) USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op7_embedding_links": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS d, vec_id AS r FROM v UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
        SELECT d AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(r) AS component_id, min(r) = d AS kept
        FROM reach LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = d GROUP BY d, n""",
}
