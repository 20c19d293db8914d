"""Registered queries of the operators, over whole tables, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomark.llm import byte_bpe, decontamination, html_text, merkle, minhash, neighbours, packing, pii, prefix_trie, quality, secret_scan, token_files, toxicity
from orthomark.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_decontamination", sql=r"""
WITH lowered AS (SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
                 UNION ALL
                 SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
tokens AS (SELECT side, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered),
item_windows AS (SELECT DISTINCT id AS item_id, array_to_string(w[i : i + 12], ' ') AS win, least(len(w), 13) AS n
                 FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM tokens WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
                FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tokens, sizes WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT DISTINCT d.id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b USING (win, n)),
hit_words AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY id),
hit_items AS (SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
              FROM hits GROUP BY id)
SELECT t.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tokens t LEFT JOIN hit_words h ON h.id = t.id LEFT JOIN hit_items m ON m.id = t.id WHERE side = 'd'""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(items, 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


@query("op3_minhash", sql=r"""
WITH RECURSIVE tokens AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM tokens WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM tokens UNION SELECT d, b FROM reach JOIN links ON a = r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) LEFT JOIN sizes USING (doc_id)""")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def spans_sql(kinds: dict[str, tuple[str, str]], base: tuple[str, ...]) -> str:
    """SQL of the span queries: ``kinds`` maps a kind to its regex and the test of a match ``m``."""
    parts = []
    for order, (kind, (pattern, test)) in enumerate(kinds.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, m, before + list_sum(list_transform(p[1:i], lambda x: length(x))) AS s FROM (
  SELECT doc_id, p, i, a[i] AS m, coalesce(list_sum(list_transform(a[1:i-1], lambda x: length(x))), 0) AS before
  FROM (SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}') AS a,
               unnest(range(1, len(regexp_extract_all(text, '{quoted}')) + 1)) AS i FROM documents))
  WHERE {test}""")
    listed = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, ord)"
    is_base = "kind IN (" + ", ".join(f"'{k}'" for k in base) + ")"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return ("WITH spans AS (" + "\nUNION ALL\n".join(parts) + f"), found AS (SELECT doc_id, {counts}, {listed} FILTER ({is_base}) AS b, {listed} AS a FROM spans GROUP BY doc_id)\n"
            f"SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans "
            "FROM documents LEFT JOIN found USING (doc_id)")


def number_of(kind: str | int, spans: str = "spans", field: str = "kind") -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == kind)).cast("long")


SECRET_VALUE = r"regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?(.*)$', 1)"


@query("op4_secrets", sql=spans_sql({
    kind: (r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+" if kind == "assign" else pattern,
           f"length({SECRET_VALUE}) >= {least}" if kind == "assign" else f"length(m) >= {least}")
    for kind, (pattern, least) in {**secret_scan.BASE_RULES, **secret_scan.MORE_RULES}.items()}, tuple(secret_scan.BASE_RULES)))
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_RULES))
    return found.select("doc_id", *[number_of(kind).alias(f"n_{kind}") for kind in secret_scan.BASE_RULES], F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[number_of(k, "base", "ord").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
                        F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_tokens")
def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.checksums(spark, folder)


@query("op8_neighbours", sql="""
WITH usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
           FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_grams", "log_weight", "sample_key")


@query("op9_html")
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def crc32_sql(digits: str) -> str:
    """Unsigned crc32 of a number in decimal: eight shifts a byte, by the reflected polynomial."""
    shifts = "list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x))"
    return (f"xor(list_reduce(list_transform(string_split(CAST({digits} AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)), "
            f"lambda c, x: {shifts}, CAST(4294967295 AS BIGINT)), 4294967295)")


def leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


@query("op12_merkle", sql=f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS g, {leaf_sql("text")} AS leaf,
         {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up AS (SELECT g, 0 AS lvl, i AS pos, n, leaf AS h FROM placed
       UNION ALL
       SELECT g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, n, pos // 16),
subroots AS (SELECT g, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
        UNION ALL
        SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 16),
own AS (SELECT p.rid, p.g, p.i AS pos, s.depth, s.pos AS top_pos FROM placed p JOIN subroots s USING (g)),
ways AS (SELECT rid, lvl AS k, CAST(pos // CAST(power(16, lvl) AS BIGINT) AS BIGINT) AS place, g FROM own, unnest(range(depth)) AS u(lvl)
         UNION ALL
         SELECT rid, depth + lvl, CAST(top_pos // CAST(power(16, lvl) AS BIGINT) AS BIGINT), NULL FROM own, (SELECT DISTINCT lvl FROM top WHERE n > 1)),
steps AS (SELECT w.rid, w.k, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < w.place), '') AS before,
                 coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > w.place), '') AS after
          FROM ways w JOIN up u ON u.g = w.g AND u.lvl = w.k AND u.pos // 16 = w.place // 16 GROUP BY w.rid, w.k, w.place
          UNION ALL
          SELECT w.rid, w.k, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < w.place), ''),
                 coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > w.place), '')
          FROM ways w JOIN own o USING (rid) JOIN top u ON w.g IS NULL AND u.lvl = w.k - o.depth AND u.pos // 16 = w.place // 16 GROUP BY w.rid, w.k, w.place),
fold AS (SELECT rid, 0 AS k, CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN tampered ELSE leaf END AS h FROM leaves
         UNION ALL
         SELECT f.rid, f.k + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.rid = f.rid AND s.k = f.k),
folded AS (SELECT rid, arg_max(h, k) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS siblings FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM placed p JOIN subroots s USING (g) JOIN folded f USING (rid) LEFT JOIN proof q USING (rid) JOIN top r ON r.n = 1""")
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = merkle.leaf_digest([*merkle.FIELDS[:-1], F.translate("text", merkle.UPPER, merkle.LOWER)])
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.proofs(docs, "source", ["doc_id"], presented=F.when(altered, lowered))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_prefix_trie", sql=f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx
               FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(struct_pack(r := role, t := text) ORDER BY idx) AS l FROM turns GROUP BY conv_id),
shared AS (SELECT c, c - c % 100 AS b, l, {crc32_sql("c")} % 6 AS h FROM own),
rebuilt AS (SELECT s.c, list_concat(coalesce(b.l, [])[1:s.h], s.l[s.h + 1:]) AS l FROM shared s LEFT JOIN own b ON b.c = s.b),
prefixes AS (SELECT c, len(l) AS n, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends,
                 CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
figures AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (SELECT p[1:k] AS p, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
          FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM figures) GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM figures f JOIN below b USING (p) LEFT JOIN figures q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.p = f.p[1:f.depth - 1]""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.share_openings(turns))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
