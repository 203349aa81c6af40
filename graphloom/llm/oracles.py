"""DuckDB oracles of the opN_<name> queries that SQL can express.

EXACT, SUBSTRING and NEAR follow the contract alone. MIXING, SHARDING, url_sql and LANGUAGE state the operator's published
method in SQL, over whole tables at once where the operator works in parts, as the contract leaves their choices
open. Nothing is imported from the operators: the parameters below are the documented ones, written out again.
"""

from __future__ import annotations

#: op2: weights, percent of all sizes, repeats, words a block and a shard, shards a bucket, step of the block permutation.
WEIGHTS, SHARE_PERCENT, REPEATS = (5, 2, 1), 150, 2
BLOCK_WORDS, SHARD_WORDS, BUCKET_SHARDS, STEP = 32, 65_536, 1024, 2_654_435_761
#: op4: shards, bits of a level, share of a shard from which a group is cut.
SHARDS, LEVEL_BITS, WHOLE_SHARE = 24, 4, 0.25

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

SUBSTRING = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50) x),
    firsts AS (SELECT t, min(doc_id) AS owner FROM win GROUP BY t),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM win JOIN firsts USING (t) WHERE owner < doc_id),
    word AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

NEAR = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(t) AS t FROM (
        SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 4) x
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3) y),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d WHERE doc_id IN (SELECT a FROM both_ways) UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
    comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""


def _cell(index: int) -> tuple[int, ...]:
    """The cell at a place of the Hilbert curve: Skilling's transform the other way round, from the index to the axes."""
    digits = f"{index:0{3 * LEVEL_BITS}b}"
    x = [int(digits[k::3], 2) for k in range(3)]
    low = x[2] >> 1
    x = [x[0] ^ low, x[1] ^ x[0], x[2] ^ x[1]]
    for q in (1 << b for b in range(1, LEVEL_BITS)):
        for i in (2, 1, 0):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ swap, x[i] ^ swap
    return tuple(x)


_PLACE = {_cell(i): i for i in range(1 << 3 * LEVEL_BITS)}
_TABLE = "[" + ", ".join(str(_PLACE[cell]) for cell in sorted(_PLACE)) + "]"
_SIDE = 1 << LEVEL_BITS


def _level(i: int) -> str:
    return f"""lev{i} AS (SELECT dim{i}, CAST(floor((sum(c) OVER (ORDER BY dim{i} NULLS LAST) - CAST(c AS DOUBLE) / 2) * {_SIDE} / sum(c) OVER ()) AS INT) AS l
        FROM (SELECT dim{i}, count(*) AS c FROM d GROUP BY dim{i}) x)"""


def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, b: xor(a >> 8, [{', '.join(map(str, _crc_table()))}][(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""

SHARDING = f"""
    WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest,
               coalesce(md5(CAST(doc_id AS VARCHAR)), md5('')) AS id_hash, source AS dim0, lang AS dim1 FROM documents),
    {_level(0)}, {_level(1)},
    g AS (SELECT digest, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS size, arg_min({{'a': dim0, 'b': dim1}}, doc_id) AS h FROM d GROUP BY digest),
    placed AS (SELECT digest, bytes, {_TABLE}[lev0.l * {_SIDE * _SIDE} + lev1.l * {_SIDE} + CAST(least(greatest(floor(log2(size) - 3), 0), {_SIDE - 1}) AS INT) + 1] AS curve
        FROM g JOIN lev0 ON lev0.dim0 IS NOT DISTINCT FROM h.a JOIN lev1 ON lev1.dim1 IS NOT DISTINCT FROM h.b),
    s AS (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY curve, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, greatest(CAST(sum(bytes) OVER () AS BIGINT), 1) / CAST({SHARDS} AS DOUBLE) AS each FROM placed),
    r AS (SELECT d.*, curve, each, start + bytes * CASE WHEN bytes > {WHOLE_SHARE} * each THEN CAST('0x' || substr(id_hash, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE ELSE 0.5::DOUBLE END AS pos FROM d JOIN s USING (digest)),
    t AS (SELECT *, CAST(least(floor(pos / each), {SHARDS - 1}) AS INT) AS shard FROM r),
    crcs AS (SELECT digest, any_value(crc) AS crc FROM (SELECT digest, {_CRC} AS crc FROM (SELECT DISTINCT digest, text FROM d) x) y GROUP BY digest)
    SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos, digest, id_hash, doc_id) - 1 AS slot,
           CAST(NULL AS INT) AS grown_shard, curve FROM t JOIN crcs USING (digest)
"""


_SKEY = "coalesce('=' || source, '~')"


def _sainte_lague(parties: str, out: str, key: str, group: str | None) -> str:
    """Quotas by highest quotients: one row a seat, so only for small inputs."""
    over = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return f"""{out}_seat AS (SELECT {g}{key}, row_number() OVER ({over}ORDER BY votes / (2 * k + 1) DESC, {key}) AS place, seats
            FROM (SELECT {g}{key}, CAST(votes AS DOUBLE) AS votes, seats, unnest(generate_series(0, CAST(floor(votes * seats / (sum(votes) OVER ({over}))) + 2 + (count(*) OVER ({over})) AS BIGINT))) AS k FROM {parties} WHERE votes > 0) x),
        {out} AS (SELECT {g}{key}, count(*) AS quota FROM {out}_seat WHERE place <= seats GROUP BY {g}{key})"""


MIXING = f"""
    WITH d AS (SELECT doc_id, source, {_SKEY} AS skey, CAST(len({WORDS}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    src AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey, source),
    w AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, {REPEATS} * source_size AS cap FROM src),
    lev AS (SELECT *, (CAST(sum(source_size) OVER () * {SHARE_PERCENT} - 100 * coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(100 * sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
    t AS (SELECT skey, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT max(level) FROM lev WHERE level <= cap / weight), CAST(cap AS DOUBLE))) AS target FROM lev),
    dealt AS (SELECT d.*, source_size, target, CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(greatest(source_size, 1) / {SHARD_WORDS}.0::DOUBLE) AS BIGINT) AS shard FROM d JOIN t USING (skey)),
    sh AS (SELECT skey, shard, shard // {BUCKET_SHARDS} AS bucket, CAST(sum(size) AS BIGINT) AS words, CASE WHEN sum(size) > 0 THEN greatest(1, CAST(round(CAST(sum(size) AS BIGINT) / {BLOCK_WORDS}.0::DOUBLE) AS BIGINT)) ELSE 0 END AS blocks FROM dealt WHERE size > 0 GROUP BY skey, shard),
    ask0 AS (SELECT skey, CASE WHEN any_value(source_size) > 0 THEN any_value(target) / any_value(source_size) * CAST(sum(blocks) AS BIGINT) ELSE 0 END AS votes FROM sh JOIN t USING (skey) GROUP BY skey),
    ask AS (SELECT skey, votes, CAST(round(sum(votes) OVER ()) AS BIGINT) AS seats FROM ask0),
    {_sainte_lague('ask', 'seats', 'skey', None)},
    ask2 AS (SELECT skey, bucket, CAST(sum(blocks) AS BIGINT) AS votes, any_value(coalesce(quota, 0)) AS seats FROM sh LEFT JOIN seats USING (skey) GROUP BY skey, bucket),
    {_sainte_lague('ask2', 'lots', 'bucket', 'skey')},
    ask3 AS (SELECT skey, bucket, shard, blocks AS votes, coalesce(quota, 0) AS seats FROM sh LEFT JOIN lots USING (skey, bucket)),
    {_sainte_lague('ask3', 'quotas', 'shard', 'skey, bucket')},
    q AS (SELECT sh.skey, sh.shard, words, blocks, least(coalesce(quota, 0), {REPEATS} * blocks) AS quota, CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('mix:' || sh.skey || ':' || sh.shard), 1, 8) AS BIGINT) % blocks ELSE 0 END AS shift
          FROM sh LEFT JOIN quotas USING (skey, shard)),
    placed AS (SELECT dealt.*, words, blocks, quota, shift, CAST(coalesce(sum(size) OVER (PARTITION BY dealt.skey, dealt.shard, dealt.size > 0 ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM dealt LEFT JOIN q USING (skey, shard)),
    part AS (SELECT doc_id, b, size, skey, shard, words, blocks, quota, shift, unnest(generate_series(((b + 1) * blocks - 1) // words, ((b + size) * blocks - 1) // words)) AS i FROM placed WHERE size > 0),
    extra AS (SELECT doc_id, skey, shard, b, CAST(sum(least(((i + 1) * words) // blocks, b + size) - greatest((i * words) // blocks, b)) AS BIGINT) AS x FROM part WHERE (i * {STEP} + shift) % blocks < quota % blocks GROUP BY doc_id, skey, shard, b)
    SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size = 0 THEN 0 ELSE (quota // blocks) * p.size + coalesce(x, 0) END AS taken
    FROM placed p LEFT JOIN extra e ON e.doc_id = p.doc_id AND e.skey = p.skey AND e.shard = p.shard AND e.b = p.b AND p.size > 0
"""

_RULE = "ends_with('.' || host, '.' || '{h}') AND starts_with(path, '{p}')"
_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_level(k: int) -> str:
    """One level of the tree: segments, branches, and the rows that go on to the next."""
    off = lambda c: f"abs({c} / CAST(n AS DOUBLE) - all_{c} / CAST(all_n AS DOUBLE)) > 2.0 * sqrt((all_{c} / CAST(all_n AS DOUBLE)) * (1 - all_{c} / CAST(all_n AS DOUBLE)) / n)"
    return f"""
    seg{k} AS (SELECT host, template, parts[{k + 1}] AS part, any_value(passed) AS passed, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(good) AS BIGINT) AS good, CAST(sum(n) AS BIGINT) AS n,
        CAST(sum(CASE WHEN len(parts) <= {k + 1} THEN n ELSE 0 END) AS BIGINT) AS ends FROM row{k} GROUP BY 1, 2, 3),
    br{k} AS (SELECT host, template, any_value(passed) AS was, CAST(sum(bad) AS BIGINT) AS all_bad, CAST(sum(good) AS BIGINT) AS all_good, CAST(sum(n) AS BIGINT) AS all_n, CAST(sum(ends) AS BIGINT) AS all_ends,
        count(*) AS segments, count(part) AS deeper, coalesce(sum(bad / CAST(bad + good AS DOUBLE)) FILTER (bad + good > 0), 0) AS impure, count(*) FILTER (bad + good > 0) AS labelled FROM seg{k} GROUP BY 1, 2),
    end{k} AS (SELECT host, template, (all_bad + 2 * was) / (all_bad + all_good + 2) AS purity FROM br{k} WHERE all_bad = all_n OR all_good = all_n OR all_bad + all_good = 0 OR deeper = 0),
    named{k} AS (SELECT *, CASE WHEN part IS NULL THEN '$' WHEN segments = 1 OR {off('bad')} OR {off('good')} OR {off('ends')} THEN '/' || part ELSE '/*' END AS name
        FROM seg{k} JOIN br{k} USING (host, template) ANTI JOIN end{k} USING (host, template)),
    part{k} AS (SELECT host, template, name, any_value(impure) AS impure, any_value(labelled) AS labelled, any_value(was) AS was, list(part) AS parts_in,
        coalesce(sum(bad / CAST(bad + good AS DOUBLE)) FILTER (bad + good > 0), 0) AS own, count(*) FILTER (bad + good > 0) AS own_n FROM named{k} GROUP BY 1, 2, 3),
    row{k + 1} AS (SELECT r.host, r.shape, r.bad, r.good, r.n, r.parts, r.template || m.name AS template, (impure - own + 2 * was) / (labelled - own_n + 2) AS passed
        FROM row{k} r JOIN named{k} m ON m.host = r.host AND m.template = r.template AND m.part IS NOT DISTINCT FROM r.parts[{k + 1}] JOIN
        (SELECT host, template, name, own, own_n FROM part{k}) p ON p.host = m.host AND p.template = m.template AND p.name = m.name)"""


#: Levels that the statement spells out: paths of the tables have two segments.
URL_LEVELS = 4


def url_sql(rules) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda f: "CASE " + " ".join(f"WHEN {_RULE.format(h=r[1], p=r[2])} THEN '{f(r)}'" for r in ordered) + " END"
    segment = r"""CASE WHEN regexp_matches(split_part(s, '.', 1), '^[0-9]+$') THEN '*' || substr(s, len(split_part(s, '.', 1)) + 1)
            WHEN regexp_matches(split_part(s, '.', 1), '^[0-9a-z-]{6,}$') AND regexp_matches(split_part(s, '.', 1), '[0-9]') AND regexp_matches(split_part(s, '.', 1), '[a-z-]') THEN '*' || substr(s, len(split_part(s, '.', 1)) + 1) ELSE s END"""
    return f"""
    WITH u AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT *, {pick(lambda r: r[1] + r[2])} AS rule, {pick(lambda r: r[0])} AS by_rule,
        list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {segment}) AS parts FROM u),
    shapes AS (SELECT host, parts, array_to_string(list_prepend('', parts), '/') AS shape, count(*) FILTER (by_rule = 'block') AS bad, count(*) FILTER (by_rule = 'allow') AS good, count(*) AS n FROM r GROUP BY host, parts),
    row0 AS (SELECT host, shape, bad, good, n, parts, '' AS template, CAST(0.5 AS DOUBLE) AS passed FROM shapes),
    {', '.join(_url_level(k) for k in range(URL_LEVELS))},
    judged AS ({' UNION ALL '.join(f"SELECT w.host, w.shape, purity FROM row{k} w JOIN end{k} USING (host, template)" for k in range(URL_LEVELS))})
    SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
    FROM r JOIN judged j ON j.host = r.host AND j.shape = array_to_string(list_prepend('', r.parts), '/')
    """


def _grams(source: str, keys: str) -> str:
    """(keys, code) rows of the 1 to 3 characters from each of the column t of source, words between single spaces."""
    return f"""
        SELECT {keys}, unnest([CASE WHEN b <> ' ' THEN b END, CASE WHEN c IS NOT NULL AND NOT (b = ' ' AND c = ' ') THEN b || c END, CASE WHEN d IS NOT NULL AND c <> ' ' THEN b || c || d END]) AS code FROM (
            SELECT {keys}, b, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS c, lead(b, 2) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM (
                SELECT {keys}, unnest(h) AS b, unnest(generate_series(1, len(h))) AS i FROM (
                    SELECT {keys}, regexp_extract_all(' ' || trim(regexp_replace(lower(t), '[\\x00-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' ', '(?s).') AS h FROM {source}) x) y) z"""


def _crc_of(text: str) -> str:
    return _CRC.replace("encode(text)", f"encode({text})")


LANGUAGE = f"""
    WITH d AS (SELECT doc_id, text AS t, lang, {_crc_of("coalesce(CAST(doc_id AS VARCHAR), '')")} % 4 = 2 AS held_out FROM documents),
    g AS (SELECT doc_id, lang, held_out, code, count(*) AS n FROM ({_grams('d', 'doc_id, lang, held_out')}) x WHERE code IS NOT NULL GROUP BY ALL),
    profile AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS rank FROM
        (SELECT lang, code, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code) x QUALIFY rank < 400),
    own AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS rank FROM g QUALIFY rank < 300),
    langs AS (SELECT DISTINCT lang FROM profile),
    far AS (SELECT o.doc_id, l.lang, CAST(sum(coalesce(abs(o.rank - p.rank), 400)) AS BIGINT) AS far, count(*) AS n
        FROM own o CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.code = o.code GROUP BY o.doc_id, l.lang),
    best AS (SELECT doc_id, lang, far, n FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
    SELECT d.doc_id, held_out, CASE WHEN coalesce(regexp_matches(t, '\\p{{L}}'), false) THEN coalesce(b.lang, (SELECT min(lang) FROM langs), 'und') ELSE 'und' END AS lang_pred,
        CASE WHEN coalesce(regexp_matches(t, '\\p{{L}}'), false) THEN coalesce(1 - CAST(far AS DOUBLE) / (400 * n), 0) ELSE 0 END AS score
    FROM d LEFT JOIN best b ON b.doc_id = d.doc_id
"""
