"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sparkassay.session import scratch_path

from . import forest, jaccard, lines, packing, personal, phrases, quality, quantised, repeats, tokenfiles, transducer, warc, whitening
from .registry import ORACLES, QUERIES, query, table  # noqa: F401


@query(
    "op8_line_spread",
    f"""WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
c AS (SELECT * FROM l WHERE regexp_matches(line, '[^ \\t-\\r]')),
shared AS (SELECT line FROM c GROUP BY line HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
w AS (SELECT doc_id FROM c LEFT JOIN shared USING (line) GROUP BY doc_id
  HAVING 100 * coalesce(sum(length(line)) FILTER (WHERE shared.line IS NULL), 0) >= {lines.OWN_PERCENT} * sum(length(line))),
bad AS (SELECT line FROM c SEMI JOIN shared USING (line) SEMI JOIN w USING (doc_id) GROUP BY line
  HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(bad.line) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE bad.line IS NULL), '') AS kept
  FROM l LEFT JOIN bad ON l.line = bad.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k""",
)
def op8_line_spread(spark, sf):
    out = lines.remove_boilerplate(table(spark, sf, "documents"), report=True)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


@query("op1_packing")
def op1_packing(spark, sf):
    files = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("json", "tiktoken"))
    return packing.pack(table(spark, sf, "documents"), *files, ids=False)


@query("op10_token_files")
def op10_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_token_files(spark, path, ids=False)


@query(
    "op2_warc",
    f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f""",
)
def op2_warc(spark, sf):
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf, "pages"), path)
    files = spark.read.parquet(f"{path}/list")
    page = {c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1) for c in ("record_id", "refers_to")}
    number = {c: F.when(x != "", x).cast("long") for c, x in page.items()}
    return warc.read_archives(files, payload=False).select(
        number["record_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", number["refers_to"].alias("refers_to")
    )


@query("op4_quality")
def op4_quality(spark, sf):
    path = scratch_path(spark, "scored")
    quality.score(table(spark, sf, "documents"), keep=["doc_id", "lang"]).write.parquet(path)
    return quality.judge(spark.read.parquet(path)).select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op7_personal")
def op7_personal(spark, sf):
    found = personal.find(table(spark, sf, "documents"), keep=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in personal.KINDS], "base_sha256", "spans")


@query("op3_jaccard")
def op3_jaccard(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query("op5_forest")
def op5_forest(spark, sf):
    return forest.nearest(table(spark, sf, "embeddings"))


@query("op6_repeats")
def op6_repeats(spark, sf):
    return repeats.remove_repeats(table(spark, sf, "documents"), with_text=False)


@query("op9_transducer")
def op9_transducer(spark, sf):
    return transducer.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


@query("op13_whitening")
def op13_whitening(spark, sf):
    out = whitening.whiten(table(spark, sf, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op12_phrases",
    f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n-\r]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS q, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
w AS (SELECT lang, q, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM q),
g AS (SELECT lang, w1, lead(w1) OVER v AS w2, lead(w1, 2) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY q ORDER BY i)),
f AS (SELECT lang, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= {phrases.LEAST} AND contains(phrase, ' ')),
k AS (SELECT *, unnest(range(1, len(w))) AS cut FROM c),
e AS (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM k),
s AS (SELECT e.lang, e.phrase, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM e JOIN f l ON l.lang = e.lang AND l.phrase = head JOIN f r ON r.lang = e.lang AND r.phrase = tail),
m AS (SELECT lang, phrase, a, unnest(arg_min(struct_pack(l := l, r := r, score := score), (score, cut))) FROM s GROUP BY lang, phrase, a),
d AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE len(w) = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE len(w) = 3),
t AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = m.lang AND d.phrase = m.phrase AND 100 * d.a >= {phrases.COVER} * m.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT o.lang, rank::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {phrases.TOP}""",
)
def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents")).withColumn("rank", F.col("rank").cast("int"))


@query(
    "op11_vector_duplicates",
    f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {quantised.COSINE}),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
s AS (SELECT a, min(b) AS low FROM c GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
o AS (SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id
  FROM v LEFT JOIN s ON s.a = vec_id LEFT JOIN n ON n.a = vec_id)
SELECT *, vec_id = component_id AS kept FROM o""",
)
def op11_vector_duplicates(spark, sf):
    return quantised.near_duplicates(table(spark, sf, "embeddings"))
