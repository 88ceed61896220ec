"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_decode
from .hard_negatives import hard_negatives
from .merkle import folded_root, leaf_of, manifest
from .ngram_join import jaccard_classes
from .packing import pack
from .pii import personal_data
from .quality_classifier import resampled
from .quality_rules import BOILERPLATE, quality_rules
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .url_filters import judge_urls
from .warc import archived

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), VOCABULARY)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_read(spark, sf_dir, "documents"), VOCABULARY)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(_read(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: where 3 divides the checksum of the decimal id, the capitals A to Z of the text are lowered; a null id is left alone."""
    d = _read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = leaf_of(*fields, F.col("text"))
    leaves = d.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, leaf_of(*fields, lowered)).otherwise(leaf).alias("presented"))
    found = manifest(leaves)
    found = found.withColumn("folded_root", folded_root(*[F.col(c) for c in ("presented", "at", "of", "group_at", "groups", "proof")]))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest_neighbours, op2_url_filters, op3_ngram_jaccard, op4_best_fit_packing, op5_bpe, op6_suffix_dedup, op7_quality_classifier, op8_warc, op9_quality_rules, op10_sharding, op11_hard_negatives, op12_personal_data, op13_merkle_manifest)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SPACED = [f" {'  '.join(x.split())} ".replace("'", "''") for x in BOILERPLATE]
_LEFT = "padded"
for _phrase in _SPACED:
    _LEFT = f"replace({_LEFT}, '{_phrase}', ' # ')"
_COVERED = "len(pieces) - len(list_filter(string_split(left_, ' '), lambda x: x <> '' AND x <> '#'))"
_FAILS = (
    "(bars >= 3 AND 3 * bars >= n) OR (n >= 4 AND 4 * marks > n) OR (n >= 4 AND 2 * shouts > n)"
    " OR (covered > 0 AND 2 * covered >= len(pieces))"
    " OR (n > 12 AND NOT more AND (NOT regexp_matches(line, '[\\p{Po}\\p{Pe}\\p{Pf}\\p{Pi}][\\x20\\x09-\\x0D]*$') OR regexp_matches(line, '[#*%&/\\\\@·•][\\x20\\x09-\\x0D]*$')))"
)
_COUNT = lambda text, marks: f"length({text}) - length(regexp_replace({text}, '[{marks}]', '', 'g'))"



def _merkle_sql(levels: int = 7, of_groups: int = 3) -> str:
    """The trees level by level: enough levels for 8 ** levels rows of a language and 8 ** of_groups languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
    steps = [f"""r AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf('text')} END AS fold FROM documents),
      p0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, '' AS proof FROM r),
      n0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p0)"""]

    def level(k: int) -> None:
        beside = "coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {}), '')"
        steps.append(f"""s{k} AS (SELECT g, i, n, CASE WHEN n > 1 THEN {beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} ELSE '' END AS b, CASE WHEN n > 1 THEN {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} ELSE '' END AS a FROM n{k}),
      p{k + 1} AS (SELECT doc_id, p.g, leaf, p.i // 8 AS i, CASE WHEN n > 1 THEN sha256(b || fold || a) ELSE fold END AS fold, proof || b || a AS proof{', subroot' if k >= levels else ''} FROM p{k} p JOIN s{k} s ON s.g = p.g AND s.i = p.i),
      n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (n + 7) // 8 AS n FROM n{k} GROUP BY g, i // 8, n)""")

    for k in range(levels):
        level(k)
    # the languages' roots are the nodes of one more tree
    steps.append(f"""q AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM n{levels})""")
    level(levels)
    steps[-1] = steps[-1].replace(f"FROM n{levels})", "FROM t)").replace(f"FROM n{levels} GROUP", "FROM t GROUP").replace(f"FROM p{levels} p", "FROM u p")
    steps.insert(-1, f"t AS (SELECT '' AS g, i, d, n FROM q), u AS (SELECT doc_id, '' AS g, leaf, fold, proof, q.i, q.d AS subroot FROM p{levels} p JOIN q USING (g))")
    for k in range(levels + 1, levels + of_groups):
        level(k)
    last = levels + of_groups
    return f"""WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT d FROM n{last}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT d FROM n{last}) AS verified FROM p{last}"""


ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": _merkle_sql(),
    "op2_url_filters": """
        WITH u AS (SELECT page_id, url, contains(url, '://') AS ok FROM pages),
        h AS (SELECT page_id, url, CASE WHEN ok THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
              CASE WHEN ok THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
        rules(domain, prefix, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        r AS (SELECT h.*, x.rule, x.verdict AS ruled, translate(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9/.-]', '_', 'g'), '0123456789/.-', '{{{{{{{{{{|}~') AS s
              FROM h LEFT JOIN LATERAL (SELECT max_by(domain || prefix, length(domain || prefix)) AS rule, max_by(verdict, length(domain || prefix)) AS verdict FROM rules
                                        WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)) x ON true),
        t AS (SELECT page_id, ruled, substring(md5(url), 1, 1) IN ('0', '1', '2', '3') AS held, unnest(list_transform(range(1, length(s) + 1), lambda i: substring('``' || s, i, 3))) AS g FROM r WHERE s <> ''),
        sym AS (SELECT chr(CAST(unnest(range(95, 127)) AS INTEGER)) AS c),
        cls AS (SELECT unnest(['allow', 'block']) AS k),
        n AS (SELECT ruled AS k, g, count(*) AS n FROM t WHERE NOT held AND ruled IS NOT NULL GROUP BY ALL),
        cells AS (SELECT k, a.c || b.c AS ctx, b.c AS mid, b.c || z.c AS pair, z.c AS last, a.c || b.c || z.c AS g FROM cls, sym a, sym b, sym z),
        full_ AS (SELECT cells.*, coalesce(n.n, 0)::DOUBLE AS n FROM cells LEFT JOIN n ON n.k = cells.k AND n.g = cells.g),
        sums AS (SELECT *, sum(n) OVER (PARTITION BY k) AS whole, sum(n) OVER (PARTITION BY k, last) AS of_last, sum(n) OVER (PARTITION BY k, pair) AS of_pair,
                 sum(n) OVER (PARTITION BY k, mid) AS of_mid, sum(n) OVER (PARTITION BY k, ctx) AS of_ctx, sum((n > 0)::INT) OVER (PARTITION BY k, ctx) AS kinds2 FROM full_),
        kinds AS (SELECT k, mid, count(DISTINCT pair) FILTER (of_pair > 0) AS kinds1 FROM sums GROUP BY k, mid),
        p0 AS (SELECT sums.*, kinds1, (of_last + 1) / (whole + 32) AS p FROM sums JOIN kinds USING (k, mid)),
        p1 AS (SELECT * REPLACE (CASE WHEN of_mid > 0 THEN (of_pair + kinds1 * p) / (of_mid + kinds1) ELSE p END AS p) FROM p0),
        p2 AS (SELECT k, g, ln(CASE WHEN of_ctx > 0 THEN (n + kinds2 * p) / (of_ctx + kinds2) ELSE p END) AS p FROM p1),
        d AS (SELECT a.g, CASE WHEN (SELECT count(DISTINCT k) FROM n) = 2 THEN a.p - b.p ELSE 0 END AS d FROM p2 a JOIN p2 b USING (g) WHERE a.k = 'allow' AND b.k = 'block'),
        score AS (SELECT page_id, any_value(ruled) AS ruled, any_value(held) AS held, sum(d) / count(*) AS score FROM t JOIN d USING (g) GROUP BY page_id),
        bins AS (SELECT least(greatest(floor((score + 4.0) / 8.0 * 400), 0), 399) AS bin, sum((ruled = 'allow')::INT)::DOUBLE AS g, sum((ruled = 'block')::INT)::DOUBLE AS b FROM score WHERE held AND ruled IS NOT NULL GROUP BY 1),
        err AS (SELECT bin, coalesce(sum(g) OVER w, 0) / greatest(sum(g) OVER (), 1) + (sum(b) OVER () - coalesce(sum(b) OVER w, 0)) / greatest(sum(b) OVER (), 1) AS e, sum(g) OVER () > 0 AND sum(b) OVER () > 0 AS two
                FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        best AS (SELECT CASE WHEN bool_or(two) THEN arg_min(bin, {'e': e, 'b': bin}) * 0.02 - 4.0 ELSE 0 END AS threshold FROM err)
        SELECT page_id, host, path, rule, CASE WHEN r.ruled IS NOT NULL THEN r.ruled WHEN coalesce(score, 0) >= (SELECT threshold FROM best) THEN 'allow' ELSE 'block' END AS verdict
        FROM r LEFT JOIN score USING (page_id)""",
    # documents that share a run of words, by an index of runs; classes by the least id that links lead to
    "op3_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
        r AS (SELECT doc_id, doc_id AS class FROM documents UNION SELECT l.b, r.class FROM r JOIN l ON l.a = r.doc_id WHERE r.class < l.b)
        SELECT doc_id, min(class) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id) AS n_links FROM r GROUP BY doc_id""",
    # lines with their words, then the rules on each, as the module states them
    "op9_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS c FROM g),
        p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, own, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT *, row_number() OVER () AS own FROM d)),
        m AS (SELECT doc_id, line, len({_WORDS.format('line')}) AS n, coalesce(lead(len({_WORDS.format('line')})) OVER (PARTITION BY own ORDER BY i), 0) > 0 AS more, {_COUNT('line', '|>»·•')} AS bars, {_COUNT('line', '#*$%&|<>')} AS marks,
              (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts, regexp_extract_all(lower(line), '[\\pL\\pN''’]+') AS pieces FROM l),
        k AS (SELECT *, ' ' || array_to_string(pieces, '  ') || ' ' AS padded FROM m WHERE n > 0),
        y AS (SELECT *, CASE WHEN regexp_matches(padded, '{'|'.join(_SPACED)}') THEN {_LEFT} ELSE padded END AS left_ FROM k),
        x AS (SELECT *, CASE WHEN left_ = padded THEN 0 ELSE {_COVERED} END AS covered FROM y),
        f AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER ({_FAILS}) AS n_failed_lines,
              coalesce(sum(n) FILTER ({_FAILS}), 0) AS failed_words FROM x WHERE n > 0 GROUP BY doc_id),
        a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
              CAST({_COUNT('t', '#*$%&|<>')} AS BIGINT) AS n_symbols FROM d),
        j AS (SELECT a.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
              coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(failed_words, 0) AS BIGINT) AS failed_words FROM a LEFT JOIN f USING (doc_id) LEFT JOIN p USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * failed_words <= 50 * n_words AS kept FROM j""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM r""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
              CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE place <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op1_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
}
