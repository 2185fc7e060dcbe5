"""One query per operator of this package, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom import configure
from keyloom.llm import chat, decision_list, hmm, html_blocks, merkle, packing, pair_bounds, paragraphs, pieces, secrets, simhash, suffix_array, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir); one without SQL is tested against brute force."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_hidden_markov_scores")
def op2(spark, sf_dir):
    return hmm.scored(table(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    return decision_list.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_suffix_array_dedup")
def op4(spark, sf_dir):
    return suffix_array.deduplicated(table(spark, sf_dir, "documents"))


@query("op5_paragraph_dedup")
def op5(spark, sf_dir):
    return paragraphs.deduplicated(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM vectors AS q JOIN vectors AS x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op6_exact_top_k", TOP_K_SQL)
def op6(spark, sf_dir):
    vectors = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, 5)


@query("op7_html_extraction")
def op7(spark, sf_dir):
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         coalesce(floor(turn / 256)::BIGINT, 9007199254740992) AS part,
         ((row_number() OVER (PARTITION BY conv_id, coalesce(floor(turn / 256)::BIGINT, 9007199254740992)
           ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 1024)::INTEGER AS sub FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
segments AS (
  SELECT s.conv_id, perspective, part, sub, turn, speaker, text, speaker = perspective AS own,
         concat('<|im_start|>', CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                     ELSE concat('user name=', speaker) END, chr(10)) AS head,
         concat(text, '<|im_end|>') AS body
  FROM said AS s JOIN speakers AS p ON s.conv_id = p.conv_id),
placed AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part, sub ORDER BY turn NULLS LAST, speaker, text ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS stop
  FROM segments)
SELECT conv_id, perspective, part, sub, count(*) AS n_turns,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS n_masked,
       coalesce(string_agg(CASE WHEN own THEN concat(stop - length(body), '-', stop) END, ',' ORDER BY stop), '') AS mask,
       string_agg(concat(head, body, chr(10)), '' ORDER BY turn NULLS LAST, speaker, text) AS text
FROM placed GROUP BY conv_id, perspective, part, sub
"""


@query("op9_chat_perspectives", CHAT_SQL)
def op9(spark, sf_dir):
    return chat.rotated(table(spark, sf_dir, "conversations"))


@query("op10_piece_viterbi")
def op10(spark, sf_dir):
    import public_tokenizers

    return pieces.encoded_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


RANKED_SQL = """
WITH runs AS (
  SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM runs),
held AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM held GROUP BY 1),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), corpus),
scores AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // corpus.terms))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (row), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_pair_bound_search", RANKED_SQL)
def op11(spark, sf_dir):
    return pair_bounds.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_markov_secret_scan")
def op12(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def _merkle_sql(heights: int = 6, top_heights: int = 4) -> str:
    """Trees level by level, for up to 16**heights rows of a source and 16**top_heights sources."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    before = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce([xor(4294967295::BIGINT, 0::BIGINT)] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT FOR i IN range(8)],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""
    ctes = [f"""rows AS (
  SELECT doc_id, source, sha256({before} || {field.format('text')}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({before} || {field.format(lowered)}) END AS tampered FROM documents)""",
        """s0 AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest FROM rows)"""]

    def grow(name: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(f"""{name}r{k} AS (
  SELECT g, idx // 16 AS up, list(digest ORDER BY idx) AS run, (any_value(n) + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)""")
            ctes.append(f"{name}{k + 1} AS (SELECT g, up AS idx, sha256(array_to_string(run, '')) AS digest, n FROM {name}r{k})")

    grow("s", heights)
    roots = " UNION ALL ".join(f"SELECT g, digest FROM s{k} WHERE n = 1" for k in range(heights + 1))
    ctes.append(f"subroots AS ({roots})")
    ctes.append("t0 AS (SELECT 0 AS g, g AS idx, digest, count(*) OVER () AS n FROM subroots)")
    grow("t", top_heights)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT digest FROM t{k} WHERE n = 1" for k in range(top_heights + 1)) + ")")
    joins = [f"LEFT JOIN sr{k} ON sr{k}.g = l.g AND sr{k}.up = l.idx // {16 ** (k + 1)}" for k in range(heights)]
    joins += [f"LEFT JOIN tr{k} ON tr{k}.up = l.g // {16 ** (k + 1)}" for k in range(top_heights)]
    places = [(f"sr{k}", f"(l.idx // {16 ** k}) % 16") for k in range(heights)]
    places += [(f"tr{k}", f"(l.g // {16 ** k}) % 16") for k in range(top_heights)]
    sides = ", ".join(
        f"coalesce(array_to_string({r}.run[:{d}], ''), '') AS a{i}, coalesce(array_to_string({r}.run[{d} + 2:], ''), '') AS b{i}, "
        f"{r}.run IS NOT NULL AS has{i}" for i, (r, d) in enumerate(places)
    )
    ctes.append(f"""paths AS (SELECT doc_id, leaf, subroots.digest AS subroot, root.digest AS root, coalesce(tampered, leaf) AS f0, {sides}
  FROM s0 AS l JOIN subroots ON subroots.g = l.g CROSS JOIN root {' '.join(joins)})""")
    last = "paths"
    for i in range(len(places)):
        ctes.append(f"p{i} AS (SELECT *, CASE WHEN has{i} THEN sha256(a{i} || f{i} || b{i}) ELSE f{i} END AS f{i + 1} FROM {last})")
        last = f"p{i}"
    proof = " || ".join(f"a{i} || b{i}" for i in range(len(places)))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{len(places)} AS folded_root, f{len(places)} = root AS verified FROM {last}"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))
