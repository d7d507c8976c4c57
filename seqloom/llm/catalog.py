"""One query for each operator over its whole table, with production parameters."""

from seqloom.llm import chat, codec, levels, lm, minhash, packing, phrases, quality, secrets, token_files, trie, vectors
from seqloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_token_files")
def _tokens(spark, sf):
    return token_files.token_index(table(spark, sf, "documents"))


#: All pairs that share a shingle, and the components by spreading the smallest id along the links.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


@query("op2_minhash", NEAR_SQL)
def _near(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_bpe")
def _bpe(spark, sf):
    coded = codec.encode(table(spark, sf, "documents"), keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: Components and products are exact in SQL too: floor gives whole numbers.
TOP_K_SQL = """
WITH good AS (
    SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS p FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.p, c.p) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.p) = len(c.p) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""


@query("op4_kd_search", TOP_K_SQL)
def _search(spark, sf):
    return vectors.top_k(table(spark, sf, "embeddings"))


@query("op5_chat")
def _chat(spark, sf):
    return chat.repair(table(spark, sf, "conversations"))


@query("op6_secrets")
def _secrets(spark, sf):
    return secrets.digest(table(spark, sf, "documents"))


@query("op7_quality")
def _quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op8_packing")
def _packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op9_lm")
def _lm(spark, sf):
    return lm.score(table(spark, sf, "documents"))


#: The links, and the components by spreading the smallest id along them.
NEAR_VECTORS_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x for x in embedding if x <> 0]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""


@query("op10_near_vectors", NEAR_VECTORS_SQL)
def _near_vectors(spark, sf):
    return vectors.near_duplicate_vectors(table(spark, sf, "embeddings"))


#: Pieces and words as lists; every phrase as a slice of its piece. Products in 128-bit integers.
PHRASES_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
    SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
inner_ AS (
    SELECT lang, w, max(f) AS longer FROM (SELECT lang, f, unnest([w[1:k - 1], w[2:k]]) AS w FROM f WHERE k > 2) GROUP BY ALL
), kept AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, w) WHERE k > 1 AND (longer IS NULL OR longer < f.f)),
cuts AS (SELECT lang, k, w, f AS a, c, w[1:c] AS head, w[c + 1:k] AS tail FROM kept, range(1, 5) t(c) WHERE c < k),
scored AS (
    SELECT u.lang, u.w, a, c, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts u JOIN f x ON x.lang = u.lang AND x.w = u.head JOIN f y ON y.lang = u.lang AND y.w = u.tail JOIN n ON n.lang = u.lang
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM worst) QUALIFY rank <= 2000
"""


@query("op11_phrases", PHRASES_SQL)
def _phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op12_online_packing")
def _online_packing(spark, sf):
    return levels.pack_online(table(spark, sf, "documents"))


#: Nodes as lists of turns, subtrees by their members' prefixes; crc32 bit by bit.
TRIE_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids UNION ALL
    SELECT conv_id, s, i + 1, list_reduce([xor(c, ascii(s[i + 1])), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    FROM crc WHERE i < length(s)
), h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), r AS (
    SELECT h.conv_id, i, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND i < h
    UNION ALL SELECT h.conv_id, i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND i >= h
), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM r),
m AS (
    SELECT conv_id, depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path, text FROM d
    UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[][]), '' FROM ids
), nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS id, count(*) AS n, any_value(text) AS text FROM m GROUP BY path),
spot AS (SELECT conv_id, m.depth, id FROM m JOIN nodes USING (path)),
up AS (SELECT nodes.id, nodes.depth, nodes.n, nodes.text, spot.id AS parent FROM nodes LEFT JOIN spot ON spot.conv_id = nodes.id AND spot.depth = nodes.depth - 1),
kids AS (SELECT parent AS id, depth - 1 AS depth, count(*) AS k FROM up WHERE depth > 0 GROUP BY ALL),
own AS (SELECT up.*, coalesce(k, 0) AS k, (n - 1) * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS saved FROM up LEFT JOIN kids USING (id, depth)),
total AS (
    SELECT spot.id, spot.depth, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
    FROM own JOIN spot ON spot.conv_id = own.id AND spot.depth <= own.depth GROUP BY ALL
), ends AS (
    SELECT spot.id, spot.depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
    FROM spot JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id) e USING (conv_id, depth) GROUP BY ALL
)
SELECT own.id AS conv_id, own.depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, CAST(total.leaves AS BIGINT) AS n_leaves,
       CAST(total.saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM own JOIN total USING (id, depth) LEFT JOIN ends USING (id, depth)
"""


@query("op13_trie", TRIE_SQL)
def _trie(spark, sf):
    return trie.prefix_trie(table(spark, sf, "conversations"))
