"""DuckDB SQL for the rows of the corpus queries that SQL can express."""

from __future__ import annotations

#: crc32 by a table of 256 values, which is made from its polynomial (3988292384, bits reversed).
_CRC_TABLE = """
    crc_table AS (
        SELECT list(c ORDER BY b) AS crc_of FROM (
            SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)
        )
    )"""


def _crc32(s: str) -> str:
    """Of an ASCII string, beside crc_table."""
    steps = f"list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: ord(x)::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
        WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: A base32 digit for each five bits of the SHA-1, which is read from its hex digits five at a time.
WARC = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS k FROM pages
    ), d AS (
        SELECT page_id, k, strlen(html) AS n, list_transform(range(8), lambda g: ('0x' || substr(sha1(html), g * 5 + 1, 5))::BIGINT) AS v,
            first_value(k) OVER w AS first_k, first_value(page_id) OVER w AS first_page
        FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, k)
    )
    SELECT page_id, n::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
        CASE WHEN k = first_k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k <> first_k THEN first_page END AS refers_to
    FROM d
"""

CONVERSATIONS = f"""
    WITH RECURSIVE {_CRC_TABLE}, keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
    ), marked AS (
        SELECT conv_id, turn, role, text, {_crc32("key")} % 20 AS kind FROM keyed, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM marked, LATERAL (SELECT unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))) WHERE kind <> 0
    ), placed AS (
        SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged
    ), faulty AS (
        SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair,
            CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ), counts AS (
        SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
            count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
            count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(place) AS n
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id
    ), inserts(q, upto, more, letters, lines) AS (
        VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('', 'u', 2, 'I', '\nuser:'), ('', 'a', 4, 'II', '\nuser:\nassistant:'),
            ('s', 'u', 2, 'I', '\nuser:'), ('s', 'a', 4, 'II', '\nuser:\nassistant:'), ('u', 'a', 2, 'I', '\nassistant:'), ('a', 'u', 2, 'I', '\nuser:')
    ), edits(q, edit, initial, upto, more, role) AS (
        VALUES ('', 'D', NULL, '', 3, NULL), ('s', 'D', NULL, 's', 3, NULL), ('u', 'D', NULL, 'u', 3, NULL), ('a', 'D', NULL, 'a', 3, NULL),
            ('', 'K', 's', 's', 0, NULL), ('', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL),
            ('', 'R', NULL, 'u', 2, 'user'), ('s', 'R', NULL, 'u', 2, 'user'), ('a', 'R', NULL, 'u', 2, 'user'), ('u', 'R', NULL, 'a', 2, 'assistant')
    ), layers AS (
        SELECT conv_id, 0::BIGINT AS place, upto AS q, {{'cost': more, 'audit': letters, 'lines': lines}} AS best FROM counts, inserts WHERE q = ''
        UNION ALL
        SELECT l.conv_id, l.place + 1, i.upto, min({{
            'cost': l.best.cost + e.more + i.more + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END, 'audit': l.best.audit || e.edit || i.letters,
            'lines': l.best.lines || CASE WHEN e.edit = 'D' THEN '' ELSE '\n' || coalesce(e.role, f.role) || ':' || f.text END || i.lines}})
        FROM layers l JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place + 1
        JOIN edits e ON e.q = l.q AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = f.initial) JOIN inserts i ON i.q = e.upto
        GROUP BY l.conv_id, l.place, i.upto
    ), ends AS (
        SELECT l.conv_id, min(best) AS best FROM layers l JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.place = c.n WHERE q IN ('', 'a') GROUP BY l.conv_id
    )
    SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
    FROM counts c JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

WINNOW = """
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM benchmark
    ), spans AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
        FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
    ), places AS (
        SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS span FROM d, (SELECT DISTINCT n FROM spans), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
    ), found AS (
        SELECT p.k, i, n, item_id FROM places p JOIN spans s USING (n, span)
    ), hits AS (
        SELECT k, count(DISTINCT j) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY k
    ), items AS (
        SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT k, item_id FROM found) GROUP BY k
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""

MERKLE = f"""
    WITH RECURSIVE {_CRC_TABLE}, crcs AS (
        SELECT *, {_crc32("doc_id::VARCHAR")} % 2 = 0 AS tampered FROM documents, crc_table
    ), leaves AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM crcs
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS k, count(*) OVER (PARTITION BY source) AS n FROM leaves
    ), nodes AS (
        SELECT source, 0 AS level, i, n, leaf AS digest FROM placed
        UNION ALL
        SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n
    ), subroots AS (
        SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, i, n, subroot AS digest FROM subroots
        UNION ALL
        SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n
    ), below AS (
        SELECT p.k, o.level, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < p.i // (3 ** o.level)::BIGINT), '') AS l,
            coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > p.i // (3 ** o.level)::BIGINT), '') AS r
        FROM placed p JOIN nodes o ON o.source IS NOT DISTINCT FROM p.source AND o.n > 1 AND o.i // 3 = (p.i // (3 ** o.level)::BIGINT) // 3 GROUP BY p.k, o.level
    ), above AS (
        SELECT s.source, o.level, coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < s.i // (3 ** o.level)::BIGINT), '') AS l,
            coalesce(string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > s.i // (3 ** o.level)::BIGINT), '') AS r
        FROM subroots s JOIN tops o ON o.n > 1 AND o.i // 3 = (s.i // (3 ** o.level)::BIGINT) // 3 GROUP BY s.source, o.level
    ), steps AS (
        SELECT k, row_number() OVER (PARTITION BY k ORDER BY part, level) AS step, l, r FROM (
            SELECT k, 0 AS part, level, l, r FROM below UNION ALL SELECT p.k, 1, a.level, a.l, a.r FROM placed p JOIN above a ON a.source IS NOT DISTINCT FROM p.source
        )
    ), folded AS (
        SELECT k, 0::BIGINT AS step, changed AS digest FROM placed
        UNION ALL
        SELECT f.k, s.step, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.k = f.k AND s.step = f.step + 1
    ), proofs AS (
        SELECT k, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY k
    ), ends AS (
        SELECT k, arg_max(digest, step) AS folded_root FROM folded GROUP BY k
    )
    SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, coalesce(o.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
    FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT digest FROM tops WHERE n = 1) t ON true LEFT JOIN proofs o USING (k) JOIN ends e USING (k)
"""

#: Every string of 400 bytes, from texts cut into overlapping pieces of hex digits; runs of found ones by gaps between starts.
REPEATS = """
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS bytes,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), pieces AS (
        SELECT k, c, n, substr(bytes, 2 * c + 1, 2 * (1024 + 399)) AS piece FROM d, LATERAL (SELECT unnest(range(0, greatest(n - 399, 0), 1024)) AS c)
    ), strings AS (
        SELECT k, c + i AS start, md5_number(substr(piece, 2 * i + 1, 800)) AS id FROM pieces, LATERAL (SELECT unnest(range(least(1024, n - 399 - c))) AS i)
    ), found AS (
        SELECT k, start, start > lag(start) OVER (PARTITION BY k ORDER BY start) + 400 AS apart
        FROM strings WHERE id IN (SELECT id FROM strings GROUP BY id HAVING count(*) > 1)
    ), runs AS (
        SELECT k, start, count(*) FILTER (WHERE apart) OVER (PARTITION BY k ORDER BY start) AS run FROM found
    ), spans AS (
        SELECT k, min(start) AS s, max(start) + 400 AS e FROM runs GROUP BY k, run
    ), gaps AS (
        SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS since FROM spans
    ), cut AS (
        SELECT k, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(bytes, 2 * since + 1, 2 * (s - since)), '' ORDER BY s) || substr(any_value(bytes), 2 * max(e) + 1) AS kept
        FROM gaps JOIN d USING (k) GROUP BY k
    ), passages AS (
        SELECT DISTINCT k, md5_number(array_to_string(w[i : i + 49], ' ')) AS id FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)
    ), sharing AS (
        SELECT DISTINCT k FROM passages WHERE id IN (SELECT id FROM passages GROUP BY id HAVING count(*) > 1)
    )
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(kept, bytes))) AS kept_sha256, CASE WHEN s.k IS NULL THEN 0 ELSE 1 END AS shares_passage
    FROM d LEFT JOIN cut USING (k) LEFT JOIN sharing s USING (k)
"""

# Matches are set between marks, and the marks give their places. A mark that the text holds is put out by another character first.
_MARK, _OTHER = "chr(57344)", "chr(57345)"
# \s of Unicode
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _either_case(words: str) -> str:
    """The pattern with each ASCII letter in either case; folding by the engine would let other letters in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SECRET_ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_CLIENT = "(" + _either_case("client_?id|access_?key_?id|account|user(name)?") + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{4,}"""
_SECRET_ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[^""" + _BLANK + r""""''<>|]{3,}"""


def _matches(pattern: str, kind: int) -> str:
    return f"SELECT k, {kind} AS kind, string_split(regexp_replace(text, '({pattern})', {_MARK} || '\\1' || {_MARK}, 'g'), {_MARK}) AS cuts FROM d"


SECRETS = f"""
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id, replace(coalesce(text, ''), {_MARK}, {_OTHER}) AS text FROM documents
    ), cuts AS (
        {_matches(_SECRET_ASSIGN, 0)} UNION ALL {_matches("AKIA[A-Z0-9]+", 1)} UNION ALL {_matches("[0-9a-f]+", 2)}
        UNION ALL {_matches(_SECRET_CLIENT, 3)} UNION ALL {_matches("[A-Za-z0-9+/_=-]+", 4)} UNION ALL {_matches(_SECRET_ENDPOINT, 5)}
    ), parts AS (
        SELECT k, kind, i, part, sum(length(part)) OVER (PARTITION BY k, kind ORDER BY i)::BIGINT AS e FROM (SELECT k, kind, unnest(cuts) AS part, generate_subscripts(cuts, 1) AS i FROM cuts)
    ), matches AS (
        SELECT k, kind, e - length(part) AS s, e FROM parts
        WHERE i % 2 = 0 AND CASE kind
            WHEN 0 THEN length(regexp_extract(part, '{_SECRET_ASSIGN}', 2)) >= 8
            WHEN 1 THEN length(part) >= 16
            WHEN 2 THEN length(part) >= 32
            WHEN 4 THEN regexp_full_match(part, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]')
            ELSE true END
    ), weak AS (
        SELECT * FROM matches w WHERE kind >= 3 AND NOT EXISTS (FROM matches b WHERE b.k = w.k AND b.kind < 3 AND b.s < w.e AND w.s < b.e)
    ), near AS (
        SELECT w.k, w.kind, w.s, w.e, bool_or(o.kind IN (0, 2, 4)) AS secret, bool_or(o.kind IN (1, 3)) AS identifier
        FROM weak w JOIN (FROM matches WHERE kind < 3 UNION ALL FROM weak) o ON o.k = w.k AND o.s - w.e <= 256 AND w.s - o.e <= 256 GROUP BY w.k, w.kind, w.s, w.e
    ), shown AS (
        SELECT k, kind, s, e FROM matches WHERE kind < 3
        UNION ALL SELECT k, kind, s, e FROM near WHERE CASE kind WHEN 3 THEN secret WHEN 4 THEN identifier ELSE secret AND identifier END
    ), named AS (
        SELECT *, (['assign', 'access', 'hex', 'client', 'material', 'endpoint'])[kind + 1] || ':' || s || ':' || e AS span FROM shown
    ), sums AS (
        SELECT k, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind >= 3) AS n_linked,
            string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
        FROM named GROUP BY k
    )
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
    FROM d LEFT JOIN sums USING (k)
"""

#: The water level is the first, by sources in order of what fills them, that the next source is not filled by.
#: Positions solve the quadratic demand of each schedule: falling from 1.5 to 0.5, rising from 0.5 to 1.5, and up and down again.
MIXING = """
    WITH d AS (
        SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            coalesce(md5(doc_id::VARCHAR), md5('text ' || coalesce(text, ''))) AS key
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
    ), weighed AS (
        SELECT *, ([5.0, 2.0, 1.0])[(source_no % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources
    ), filled AS (
        SELECT *, total - (sum(cap) OVER o - cap) AS rest, sum(weight) OVER () - (sum(weight) OVER o - weight) AS open FROM weighed
        WINDOW o AS (ORDER BY cap / weight, source_no ROWS UNBOUNDED PRECEDING)
    ), levels AS (
        SELECT arg_min(rest / open, fills) AS level FROM (SELECT rest, open, cap / weight AS fills FROM filled) WHERE rest / open <= fills
    ), targets AS (
        SELECT source, source_size, source_no, least(cap, level * weight) AS target FROM weighed, levels
    ), placed AS (
        SELECT d.*, t.source_size, t.source_no, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size, k ROWS UNBOUNDED PRECEDING)::BIGINT - size / 2.0::DOUBLE AS middle,
            CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
        FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), copied AS (
        SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies FROM placed
    ), timed AS (
        SELECT *, list_transform(range(copies), lambda j: (middle + j * source_size) / target) AS due FROM copied
    )
    SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INTEGER AS copies,
        list_transform(due, lambda x: CASE
            WHEN x >= 1 THEN 1::DOUBLE
            WHEN source_no % 3 = 0 THEN least(1.5 - sqrt(greatest(2.25 - 2 * x, 0)), 1::DOUBLE)
            WHEN source_no % 3 = 1 THEN least(sqrt(0.25 + 2 * x) - 0.5, 1::DOUBLE)
            WHEN x < 0.5 THEN least((sqrt(0.25 + 4 * x) - 0.5) / 2, 0.5::DOUBLE)
            ELSE least(0.5 + (1.5 - sqrt(greatest(2.25 - 4 * (x - 0.5), 0))) / 2, 1::DOUBLE) END) AS positions
    FROM timed
"""

ORACLES = {
    "op2_repeats": REPEATS, "op5_topk": TOPK, "op6_secrets": SECRETS, "op7_warc": WARC, "op10_mixing": MIXING, "op11_conversations": CONVERSATIONS, "op12_winnow": WINNOW, "op13_merkle": MERKLE,
}
