"""One query for each training-data operator, applied to its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name of the vocabulary file in the public tokenizers folder.
VOCABULARY = "word_bpe_49k.json"
#: Names of the files of the two tokenizers that are aligned.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


#: The same judgement by joining every window of every length that items have.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g, least(len(w), 13) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
o AS (SELECT p.doc_id, p.i, p.k, q.item_id FROM p JOIN q USING (g, k)),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("\\\\", "\\")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


#: The same links by comparing each label's vectors, and their components by propagation.
OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l USING (a)),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, m.c = vec_id AS kept FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_all

    return identify_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op6

    return op6(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_classes

    return line_classes(_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import digest

    return digest(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import digest

    return digest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def _op11_sql() -> str:
    """The same spans by extracting and splitting with each pattern, with places as sums of the lengths before; SQL's expressions have no possessive repeats and need none."""
    luhn = "list_sum(list_transform(range(1, length({0}) + 1), lambda j: CASE WHEN (length({0}) - j) % 2 = 1 THEN (2 * CAST({0}[j] AS INT)) // 10 + (2 * CAST({0}[j] AS INT)) % 10 ELSE CAST({0}[j] AS INT) END)) % 10 = 0"
    moved = "substr(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4)"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split(list_aggregate(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), 'string_agg', ''), ''), lambda c: CAST(c AS INT))), lambda a, b: (a * 10 + b) % 97) = 1"
    card, words = r"[0-9]([\x20-]?[0-9])+", "card|visa|credit|debit|karte|carte|tarjeta"
    free = r"NOT regexp_matches(before, '[A-Za-z0-9]\z') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
    kinds = (
        ("email", 0, True, 75, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "mail|contact|write|escrib|schreib|courriel|correo", "true"),
        ("ip", 1, True, 60, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip|addr|host|server|login|adresse", "list_max(list_transform(string_split(hit, '.'), lambda v: CAST(v AS DOUBLE))) <= 255"),
        ("card", 2, True, 70, card, words, f"length(digits) BETWEEN 12 AND 19 AND {luhn.format('digits')}"),
        ("phone", 3, True, 60, r"\+[0-9][\x20().0-9-]+[0-9]", "phone|call|tel|mobil|fax|anruf|llam", "length(digits) BETWEEN 9 AND 15"),
        ("card", 2, False, 50, "[0-9]{12,}", words, f"length(hit) <= 19 AND {luhn.format('digits')} AND {free}"),
        ("iban", 4, False, 80, "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "iban|account|bank|konto|compte|cuenta", f"{mod97} AND {free}"),
        ("social", 5, False, 35, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|tax|security|insurance|versicherung", f"NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000') AND {free}"),
    )
    parts = " UNION ALL ".join(f"SELECT r, {n} AS k, '{kind}' AS kind, {listed} AS listed, {base} AS base, {score} AS score, '{w}' AS words, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for n, (kind, listed, base, score, p, w, _) in enumerate(kinds))
    valid = " ".join(f"WHEN {n} THEN {v}" for n, (*_, v) in enumerate(kinds))
    count = ", ".join(f"CAST(count(*) FILTER (WHERE s.base AND s.kind = '{n}') AS BIGINT) AS n_{n}" for n in ("email", "ip", "card", "phone"))
    listing = "coalesce(string_agg(s.kind || ':' || s.start || ':' || s.stop, ',' ORDER BY s.start, s.listed, s.stop){0}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), p AS ({parts}),
x AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM p WHERE len(h) > 0),
y AS (SELECT r, k, kind, listed, base, score, words, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS start, right(g[i], 40) AS before, left(g[i + 1], 40) AS after FROM x),
z AS (SELECT *, start + length(hit) AS stop, score + CASE WHEN regexp_matches(translate(before || ' ' || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), words) THEN 20 ELSE 0 END AS points FROM y WHERE CASE k {valid} END),
s AS (SELECT * FROM z WHERE base OR points >= 50 AND NOT (kind = 'card' AND EXISTS (SELECT 1 FROM z AS c WHERE c.r = z.r AND c.base AND c.kind = 'card' AND c.start <= z.start AND z.stop <= c.stop)))
SELECT d.doc_id, {count}, sha256({listing.format(" FILTER (WHERE s.base)")}) AS base_sha256, {listing.format(" FILTER (WHERE s.r IS NOT NULL)")} AS spans, CAST(count(*) FILTER (WHERE NOT s.base) AS BIGINT) AS n_added, coalesce(string_agg(CAST(s.points AS VARCHAR), ',' ORDER BY s.start, s.listed, s.stop), '') AS scores
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id
"""


OP11_SQL = _op11_sql()


def queries() -> dict:
    return {f.__name__: f for f in (op11_personal_data, op12_whitening, op13_alignment, op1_decontamination, op2_lm_scores, op3_line_dedup, op4_substrings, op5_toxicity, op6_simhash, op7_embeddings, op8_language, op9_token_counts, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op7_embeddings": OP7_SQL, "op11_personal_data": OP11_SQL}
