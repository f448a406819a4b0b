"""The queries of this package over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from . import exact_dedup, fill_in_middle, fingerprint, minhash, multi_index, packing, pii, prefix_trie, sentencepiece_codec, suffix_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 4096, 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out quarter."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids (count and CRC) and whether they decode to its text."""
    return sentencepiece_codec.encoded(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), keep_ids=False).drop("ids")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the doc_id that stays of its equal texts."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its edited text's."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on every page's url."""
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = """
WITH rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
hits AS (SELECT page_id, max_by(h || p, length(h || p) * 1000 + length(h)) AS rule, max_by(action, length(h || p) * 1000 + length(h)) AS action
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the strings of 200 bytes that occur elsewhere."""
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"), 200).drop("kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal words and group of near-duplicates."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes over all conversations, whose first turns are shared in groups of a hundred ids."""
    return prefix_trie.shared_trie(_table(spark, sf_dir, "conversations"), 100, 6)


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda acc, ch: list_reduce([CAST(i AS BIGINT) FOR i IN range(8)], lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)), xor(acc, ch)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
OP11_SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
again AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
          UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
path AS (SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS node, length(text) AS chars FROM again WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
every AS (SELECT conv_id, depth, node, chars FROM path UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
marked AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM every),
nodes AS (SELECT node, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n, max(chars) AS chars, bool_and(ended) AS leaf,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM marked GROUP BY node),
up AS (SELECT m.node, coalesce(p.node, []) AS parent, any_value(pn.conv_id) AS parent_conv_id FROM marked m JOIN marked p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1 JOIN nodes pn ON pn.node = p.node GROUP BY 1, 2),
below AS (SELECT a.node, count(*) FILTER (WHERE leaf) AS n_leaves, sum((d.n - 1) * d.chars) AS saved FROM (SELECT DISTINCT a.node, d.node AS down FROM marked a JOIN marked d ON d.conv_id = a.conv_id AND d.depth >= a.depth) a JOIN nodes d ON d.node = a.down GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN up u ON u.node = n.node LEFT JOIN (SELECT parent, count(*) AS n FROM up GROUP BY parent) c ON c.parent = n.node
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is rearranged, and that it can be rebuilt."""
    return fill_in_middle.report(_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


OP12_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST(CAST('0x' || substr(h, 8 * i + 1, 8) AS UBIGINT) AS BIGINT) FOR i IN range(4)] AS k FROM u),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding."""
    return multi_index.neighbours(_table(spark, sf_dir, "embeddings"), 20, 20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_sentencepiece, op4_exact_dedup, op5_fingerprints, op6_url_filter, op7_pii, op8_warc, op9_suffix_array_dedup, op10_minhash_near_dedup,
        op11_prefix_trie, op12_fill_in_middle, op13_multi_index,
    )
}
SQL = {"op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
